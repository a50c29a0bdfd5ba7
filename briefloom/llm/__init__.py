"""Corpus operators for training-data pipelines.

Every module holds one operator with a general DataFrame interface and the thin
``opN_*`` query over the synthetic tables.  Nothing outside this subpackage imports it.
"""
