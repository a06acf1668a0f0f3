"""Operators for building training data from text, page and vector tables."""
