"""Operators of a training-data pipeline; nothing outside this subpackage and corpus_pipeline.py imports it."""
