"""Filter interaction audit: forward-backward path counting over the subset lattice.

A set of filters already applied is a state of a lattice; applying one more
filter is an edge to a larger state, and every order of the filters is a path
from the empty to the full state. One pass over the documents counts, per part
of the corpus and per set of failing filters, the documents; what an edge
removes, keeps or finds removed already follows from these counts alone. The
number of orders that reach an edge's start times the number that leave its end
weighs its removals for the Shapley value; the steps of one order are read from
the same edges, so no filter is ever run again for an order.

``failures`` finds the failing conditions of each document, ``count_failures``
reduces them, ``audit`` walks the lattice for any small set of filters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import on_workers, pick, release_memory, slices, unclash
from ledgerline.plans.materialize import stage

#: Filters of :func:`failures`, by bit: short, repetitive, shouting, symbols, copy.
LETTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_UPPER_PERCENT = 2
COPY_BIT = 4

#: 2**n states times n filters are held as constants, and n! orders are returned.
MOST_FILTERS = 8

#: A longer text is cut into words piece by piece.
PIECE_BYTES = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_SYMBOL = re.compile(r"[#$%&*|]")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))


def _pieces(raw: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """``raw`` in pieces of about ``size`` bytes, cut only at white space."""
    at = 0
    while len(raw) - at > size:
        cut = _SPACE.search(raw, at + size)
        if not cut:
            break
        yield raw[at : cut.start()]
        at = cut.end()
    yield raw[at:]


def text_failures(text: str) -> int:
    """Bits of the conditions A to D that a text fails."""
    raw = text.encode()
    words, seen = 0, set()
    for piece in _pieces(raw):
        found = piece.split()  # bytes.split() cuts at exactly the six white-space bytes
        words += len(found)
        seen.update(found)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (
        (words < LEAST_WORDS)
        | (100 * len(seen) < LEAST_DISTINCT_PERCENT * words) << 1
        | (100 * upper > MOST_UPPER_PERCENT * len(text)) << 2
        | (_SYMBOL.search(text) is not None) << 3
    )


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, fails of every document: the bits of the filters that it fails.

    The copy filter fails a document whose text also belongs to a smaller
    doc_id; equality of texts is equality of their 128-bit BLAKE2b digests.

    Defined cases: a null text is the empty text and a null source the empty
    part; a document without id is no copy and makes no other a copy; rows
    repeated with one id are no copies of each other; an empty table gives an
    empty result; extra columns are dropped.
    """
    docs = pick(docs, "doc_id", "source", "text")
    on_workers(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            for a, b in slices(texts):
                rows = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([hashlib.blake2b(t.encode(), digest_size=16).digest() for t in rows], pa.binary()),
                        pa.array([text_failures(t) for t in rows], pa.int32()),
                        batch.column(1).slice(a, b - a),
                    ],
                    names=["doc_id", "digest", "fails", "source"],
                )
        release_memory()

    judged = docs.mapInArrow(run, f"doc_id {id_type}, digest binary, fails int, source string")
    # Both written once: the texts are read once, and the sides of the join are
    # plain shuffles of short rows, so a text with very many copies is split.
    slim = stage(
        judged.select("doc_id", "digest", "fails", F.coalesce("source", F.lit("")).alias("part")), "filter-failures"
    )
    first = slim.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("doc_id").alias("n")).where("n > 1")
    first = stage(first.select("digest", "first"), "first-copies")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    marked = slim.join(first, "digest", "left")
    return marked.select("doc_id", "part", F.col("fails").bitwiseOR(F.shiftleft(copy, COPY_BIT)).alias("fails"))


def count_failures(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails, n, good, toxic: documents per part and set of failing filters.

    A document is good (toxic) if any label row of its id has quality (toxic) 1.
    """
    labels = pick(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL")
    one = labels.groupBy("doc_id").agg(
        *[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(n) for c, n in (("quality", "g"), ("toxic", "t"))]
    )
    rows = failed.join(one, "doc_id", "left")
    return rows.groupBy("part", "fails").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("g", F.lit(0))).alias("good"),
        F.sum(F.coalesce("t", F.lit(0))).alias("toxic"),
    )


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """Orders of ``n`` filters that reach, and that leave, each state of the lattice."""
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):  # subsets have smaller numbers
        for f in range(n):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in range(full, -1, -1):
        for f in range(n):
            if not state >> f & 1:
                leave[state] += leave[state | 1 << f]
    return reach, leave


def lattice(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Every edge of every part: part, state, filter and what the step does.

    ``counts`` has part, fails, n, good, toxic. ``state`` is the set of filters
    applied before, ``filter`` the bit applied next; kept, removed, redundant,
    unique_fails, good_lost and toxic_lost count documents; ``shapley`` sums the
    filter's removals over all orders. Long numbers, zeros included.
    """
    n = len(letters)
    if not 1 <= n <= MOST_FILTERS or len(set(letters)) != n:
        raise ValueError(f"1 to {MOST_FILTERS} different filters")
    reach, leave = path_counts(n)
    edges = F.array(
        *[
            F.struct(
                F.lit(s).alias("state"),
                F.lit(f).alias("filter"),
                F.lit(1 << f).alias("bit"),
                F.lit(reach[s] * leave[s | 1 << f]).cast("long").alias("orders"),
            )
            for s in range(1 << n)
            for f in range(n)
            if not s >> f & 1
        ]
    )
    rows = counts.select("part", "fails", "n", "good", "toxic", F.explode(edges).alias("e")).select("*", "e.*").drop("e")
    bit = F.col("bit")
    alive = F.col("fails").bitwiseAND(F.col("state")) == 0
    fails = F.col("fails").bitwiseAND(bit) != 0

    def total(column: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(column)).otherwise(F.lit(0))).cast("long")

    made = rows.groupBy("part", "state", "filter").agg(
        F.max("orders").alias("orders"),
        total("n", alive & ~fails).alias("kept"),
        total("n", alive & fails).alias("removed"),
        total("n", ~alive & fails).alias("redundant"),
        total("n", F.col("fails") == bit).alias("unique_fails"),
        total("good", alive & fails).alias("good_lost"),
        total("toxic", alive & fails).alias("toxic_lost"),
    )
    # a filter has 2**(n-1) edges in a part
    every = Window.partitionBy("part", "filter")
    return made.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(every).cast("long"))


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Steps of every order of the filters in every part, read from the lattice's edges.

    Returns part, filter_order, step (from 1), kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley. No counts, no rows.
    """
    steps = []
    for order in permutations(range(len(letters))):
        state = 0
        for i, f in enumerate(order):
            steps.append(("".join(letters[x] for x in order), i + 1, state, f))
            state |= 1 << f
    table = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    # n! * n rows for at most MOST_FILTERS filters, whatever the corpus; only five or so are usual
    joined = lattice(counts, letters).join(F.broadcast(table) if len(letters) <= 6 else table, ["state", "filter"])
    return joined.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over a document table, per source."""
    return audit(count_failures(failures(unclash(docs, ("doc_id", "source", "text"))), labels))
