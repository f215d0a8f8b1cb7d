"""Training-data operators: language-model scores, quality, toxicity, near copies, leaks, tokens, archives, shards, URLs.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
