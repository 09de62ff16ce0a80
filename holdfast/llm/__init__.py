"""Operators of a training-data pipeline: extraction, archives, deduplication, quality, tokens, language model.

Nothing outside this package imports it.  Each module holds one operator with its own
interface; ``queries`` derives the digest columns of the registered queries from them.
"""
