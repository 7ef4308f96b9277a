"""Readers for JSON / JSONL / Parquet record files and inputs derived from the driver tables."""
