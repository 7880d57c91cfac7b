"""Training-data operators: sharding, chat formatting, token files, quality rules, secrets,
language id, SentencePiece, decontamination, near-duplicates and toxicity.

Nothing outside this folder imports it; ``corpus_pipeline.py`` and ``__spark_entry__.py`` are
its only callers.
"""
