"""Readers and writers of the engine's files. Inside it works on Parquet; CSV and JSON lines are for the edges."""
