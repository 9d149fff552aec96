"""Small document tables with the awkward cases every operator has to take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "er", str(rng.randint(0, 9))])
        out.append(w.capitalize() + "." if i % 9 == 8 else w)
    return " ".join(out)


def documents(spark, texts, start: int = 0):
    rows = [(start + i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, repeated and missing ids."""
    long_text = prose(1, 3000)
    rows = [
        (0, prose(2, 60), "en", "src0", 1),
        (1, None, None, None, None),
        (2, "", "en", "src1", 0),
        (3, " \n\t ", "en", "src1", 4),
        (4, long_text, "de", "src1", len(long_text)),
        (5, prose(2, 60), "en", "src0", 1),
        (5, prose(2, 60), "en", "src0", 1),
        (6, "é😀 " * 40, "fr", "src2", 120),
        (7, prose(3, 40), None, "src2", None),
        (7, prose(4, 40), "en", "src2", None),
        (None, prose(5, 50), "en", "src0", 1),
        (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


#: Names of columns that operators add; an input may have them too.
CLASHING = [
    "Text", "DOC_ID", "bucket", "shard", "slot", "ll_bucket", "fp", "ids", "decoded", "kept", "base_failed", "n_words",
    "contaminated", "n_pseudonyms", "uid", "start", "lo", "end", "gram", "root", "host", "rule", "verdict", "template",
]


def clashing(df):
    """The table with extra columns named like operators' own."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(n) for n in CLASHING])
