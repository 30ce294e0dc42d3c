"""Training-data operators: one module an operator, queries and SQL in ``queries``.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
