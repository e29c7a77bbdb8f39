"""Operators for text training-data pipelines. Nothing outside this folder imports it but the entry and corpus_pipeline.py."""
