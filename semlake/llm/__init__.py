"""Training-data operators over text corpora.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
