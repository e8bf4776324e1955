"""Readers of source day files, the parquet table store, and text exports."""
