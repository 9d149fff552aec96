"""Training-data operators: sharding, decontamination, quality, PII, near-dedup,
URL rules, HTML extraction, tokenisation, token storage and exact dedup.

Nothing outside this package imports it; ``__spark_entry__`` registers its
queries only when the package is present.
"""
