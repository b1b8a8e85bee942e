"""Operators for training-data pipelines: deduplication, language, URL, HTML, privacy, packing."""
