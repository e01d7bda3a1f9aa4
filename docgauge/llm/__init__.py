"""Operators of a training-data pipeline over documents, pages and labels.

Nothing outside this package imports it, except the guarded registration in
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
