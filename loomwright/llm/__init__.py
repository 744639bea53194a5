"""Training-data operators: search, extraction, scoring, deduplication, mixing and tokenization.

Nothing outside this package imports it; its queries are in :mod:`loomwright.llm.queries`.
"""
