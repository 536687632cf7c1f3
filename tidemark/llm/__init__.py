"""Operators of a training-data pipeline: mixing, deduplication, language, HTML, WARC, packing, vector search.

Nothing outside this folder (and ``corpus_pipeline.py``, ``__spark_entry__.py``) imports it.
"""
