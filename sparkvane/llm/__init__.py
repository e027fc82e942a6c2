"""Operators for large training-data corpora. Nothing outside this folder (and
``corpus_pipeline.py``) imports it, so it can be removed as a whole."""
