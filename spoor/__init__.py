"""Evidence-triage operators for Spark: DataFrames in, DataFrames out."""
