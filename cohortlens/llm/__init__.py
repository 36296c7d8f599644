"""Operators of a large-scale training-data pipeline.

One module per operator; ``queries`` binds each to its table.  Nothing
outside this folder (but the guarded import of ``__spark_entry__`` and
``corpus_pipeline``) imports it.
"""
