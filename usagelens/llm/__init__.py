"""Training-data operators: quality, near-duplicates, search, mixing, tokens, shards.

Nothing outside this subpackage (and corpus_pipeline.py) imports it.
"""
