"""Operators of a training-data pipeline: search, deduplication, quality, privacy, packing, tokens.

Nothing else in the library imports this package. ``queries`` registers one query
for each operator and ``corpus_pipeline.py`` chains five of them.
"""
