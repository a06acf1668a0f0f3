"""Readers. Each parser takes a DataFrame with a text column; ``read_*`` adds the scan."""
