"""Training-data operators: text classification, extraction, deduplication,
fingerprints, mixing and tokenisation over the ``documents`` / ``pages`` tables.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
