"""Connected components of a link table, as joins and grouped minima.

Alternating large-star and small-star rounds: each re-points links at the
smallest node seen so far until every component is one star around its smallest
node. A round is two grouped minima (partially aggregated before the shuffle and
written), joined back to the links: both sides of the join are plain shuffles, so
a node with very many links is split like any skewed join key; nothing is gathered
per node. Every round's links are written
to the shared scratch folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.materialize import stage

MAX_ROUNDS = 60


def _with_least(links: DataFrame) -> DataFrame:
    """Links (a, b) with the smallest node among a and its neighbours."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    least = stage(least, "least-neighbours")  # joined as written rows: a hub's links can be split
    return links.join(least, F.col("a") == F.col("n")).select("a", "b", "m")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b long): root is its component's smallest node.

    Links may repeat and point either way; a link of a node to itself is ignored
    (nodes without other links are not returned). No links, no rows.
    """
    def directed(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def fingerprint(df: DataFrame) -> tuple:
        h = F.xxhash64("a", "b").cast("decimal(38,0)")
        return tuple(df.agg(F.count(F.lit(1)), F.sum(h)).first())

    edges = stage(directed(links.select("a", "b")), "links")
    before = fingerprint(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = directed(large)
        small = _with_least(large)
        small = small.select("b", "m").unionAll(small.select("a", "m")).toDF("a", "b")
        edges = stage(directed(small), "links")
        after = fingerprint(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    root = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.toDF("node", "root").unionAll(root)
