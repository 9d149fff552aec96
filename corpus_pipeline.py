"""Corpus pipeline: quality rules, near-dedup, benchmark decontamination, PII, tokens.

Each stage takes all that the one before kept, as a table with the columns of
``documents``, and calls one operator of ``ledgerline.llm``. ``run`` writes every
stage's result as Parquet into the shared scratch folder and rereads it, so a
lost executor costs the current stage's tasks only.

Every stage keeps the cases its operator defines (null and empty texts, repeated
rows, an empty table, extra columns); none collects or samples documents, but the
quality stage learns from a bounded sample of labelled rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decision_list, feistel, maxplus, simhash, tiling
from ledgerline.llm.common import table, unclash
from ledgerline.plans.materialize import stage

NEEDED = ("doc_id", "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base rule and the learned decision list."""
    judged = decision_list.judge(docs, table(spark, sf_dir, "labels"))
    return _as_before(judged.where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: the one with the smallest id."""
    return _as_before(simhash.first_of_each(docs), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    verdicts = tiling.with_verdict(docs, table(spark, sf_dir, "benchmark"))
    return _as_before(verdicts.where(~F.col("contaminated")), docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal values by format-preserving pseudonyms; every document stays.

    Where a text changed, its ``n_chars`` (if there is one) is counted again.
    """
    made = feistel.pseudonymise(docs, feistel.session_key(spark))
    if "n_chars" in made.columns:
        counted = F.when(F.col("n_pseudonyms") > 0, F.length("text").cast(made.schema["n_chars"].dataType))
        made = made.withColumn("n_chars", counted.otherwise(F.col("n_chars")))
    return _as_before(made, docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip of every document that is left."""
    found = maxplus.digest(maxplus.decode(maxplus.encode(unclash(docs, NEEDED))))
    return found.select("doc_id", "ids", "n_tokens", "round_trip")


def _as_before(made: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, but those that the operator replaced by its own of that name."""
    return made.select(*[c for c in unclash(docs, NEEDED).columns if c in made.columns])


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", pseudonyms),
    ("SentencePiece encoding and decoding", pieces),
]

#: Learned rules, keyed permutations and segmentation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
