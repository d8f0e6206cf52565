"""Training-data operators: one module an operator, their queries in ``queries``.

Nothing outside this folder imports it but ``__spark_entry__`` (guarded) and
``corpus_pipeline``, which counts as part of it.
"""
