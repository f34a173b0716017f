"""Training-data operators: search, tokenising, mixing, archives, classifiers, dedup.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
Each operator has a module of its own; the registered queries are in
:mod:`adeptus.llm.queries`, their DuckDB oracles in :mod:`adeptus.llm.oracle`.
"""
