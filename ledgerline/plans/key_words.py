"""Sets of integer keys as bitmap words: 64 neighbouring keys in one row.

Surrogate keys are mostly consecutive, so a word table has about one row per 64
keys. It answers membership exactly (a Bloom filter could only prove that a key
is absent, so every key that may be present would still have to be joined), and
partial aggregation shrinks keys that lie together before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_of(key: str) -> Column:
    """Number of the word that holds a key."""
    return F.shiftright(F.col(key).cast("long"), 6)


def bit_of(key: str) -> Column:
    """The key's bit in its word."""
    return F.expr(f"shiftleft(1L, CAST(CAST({key} AS BIGINT) & 63 AS INT))")


def key_words(df: DataFrame, key: str) -> DataFrame:
    """(word, bits, n): bitmap words of the non-null keys and the rows that hold them."""
    return df.where(F.col(key).isNotNull()).groupBy(word_of(key).alias("word")).agg(
        F.bit_or(bit_of(key)).alias("bits"), F.count(F.lit(1)).alias("n"))


def holds(bits: Column, key: str) -> Column:
    """Whether a word's bits (NULL: no such word) hold a key."""
    return F.coalesce(bits.bitwiseAND(bit_of(key)) != 0, F.lit(False))
