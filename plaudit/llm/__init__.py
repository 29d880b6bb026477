"""Training-data operators: quality, language, chat, BPE, PII, rules, vectors, joins, mixing, deduplication.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries only where the package is present.
"""
