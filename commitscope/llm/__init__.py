"""Operators for preparing training corpora.

Nothing outside this package (and ``corpus_pipeline.py``) imports it; the
registered queries are in ``queries.py``.
"""
