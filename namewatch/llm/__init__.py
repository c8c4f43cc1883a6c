"""Operators for preparing training corpora: scoring, cleaning, deduplication, sharding.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
