"""SimHash near-duplicates through pivot distance tables.

Every text becomes a 64-bit fingerprint of its word shingles. Equal
fingerprints collapse into one node, so thousands of copies cost one row.
Candidate nodes meet where they agree on enough blocks of bits: with at most d
differing bits spread over B blocks, some B - d blocks are equal, and there is a
table for every choice of them. Inside a table the pivots take over: each
fingerprint's Hamming distances to many reference fingerprints are computed
once; because |d(x, p) - d(y, p)| <= d(x, y), a pair whose coordinates differ by
more than the limit anywhere is dropped, and only the survivors are compared
bit by bit. What a task finds leaves it as a spanning forest, not as pairs.

(The distances to random references crowd around 32, so on their own they would
let every fingerprint meet most others; the block tables decide who meets.)
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import add_columns, on_workers, pick, unclash
from ledgerline.llm.components import components
from ledgerline.llm.textvec import SPACE, spans, utf8
from ledgerline.plans.materialize import stage

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
PIVOTS = 16
#: A bucket with more fingerprints is split by further blocks.
HOT_BUCKET = 20_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints(texts: pa.Array, size: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit SimHash of each text's ``size``-word shingles, as uint64.

    A-Z is lower-cased, words are split at ASCII white space, shingles (repeats
    included) are joined by spaces and hashed by XXH64 with seed 42. A text of
    fewer words is one shingle; one without words has fingerprint zero. A bit is
    set if it is set in more than half of the hashes.
    """
    data, offsets = utf8(texts)
    count = len(offsets) - 1
    data = _LOWER[data]
    starts, ends, text = spans(~SPACE[data], offsets)
    out = np.zeros(count, np.uint64)
    if not len(starts):
        return out
    # words on end, one space behind each
    lengths = ends - starts
    at = np.concatenate(([0], np.cumsum(lengths + 1)))
    joined = np.full(at[-1], 32, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    joined[inside] = data[~SPACE[data]]
    flat = joined.tobytes()

    words = np.bincount(text, minlength=count)
    first = np.concatenate(([0], np.cumsum(words)))
    shingles = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(shingles)))
    number = np.arange(begin[-1]) - np.repeat(begin[:-1], shingles)
    word = np.repeat(first[:-1], shingles) + number
    last = np.minimum(word + size, np.repeat(first[1:], shingles))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(flat[a:b], SEED) for a, b in zip(at[word].tolist(), (at[last] - 1).tolist())),
        np.uint64,
        count=len(word),
    )
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    some = np.flatnonzero(shingles)
    sums = np.add.reduceat(bits, begin[some], axis=0, dtype=np.int32)
    majority = 2 * sums > shingles[some, None]
    out[some] = np.packbits(majority, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def with_fingerprint(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint's 64 bits as a long."""
    schema = T.StructType([T.StructField("fp", T.LongType(), False)])
    return add_columns(docs, "text", schema, lambda t: {"fp": pa.array(fingerprints(t, size).view(np.int64))})


def references(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed random bit patterns."""
    return np.random.default_rng(64).integers(0, 1 << 64, n, np.uint64, endpoint=False)


def block_masks(bits: int, blocks: int, max_bits: int = MAX_BITS) -> list[int]:
    """Masks over the set bits of ``bits``: one per choice of blocks - max_bits blocks."""
    where = [i for i in range(64) if bits >> i & 1]
    cuts = [round(j * len(where) / blocks) for j in range(blocks + 1)]
    parts = [sum(1 << i for i in where[a:b]) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(parts, blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def blocks_for(nodes: int, max_bits: int = MAX_BITS) -> int:
    """The fewest blocks whose keys leave about eight nodes in an average bucket."""
    for extra in range(2, 7):
        blocks = max_bits + extra
        if nodes >> (64 * extra // blocks) <= 8:
            return blocks
    return max_bits + 6


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of n nodes over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            return root
        root = new


def linked(key: np.ndarray, fp: np.ndarray, max_bits: int, keep: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Links that span, per bucket, all pairs within ``max_bits`` (indices into the input).

    ``key`` numbers the buckets. Rows are ordered by bucket and first pivot
    distance, so a row meets only the followers of its bucket whose first
    coordinate is within the limit; the other coordinates, then the bits decide.
    """
    pivots = references()
    distance = np.stack([np.bitwise_count(fp ^ p) for p in pivots], axis=1)
    order = np.lexsort((distance[:, 0], key))
    key, bits, table = key[order], fp[order], distance[order].astype(np.int16)
    a_out, b_out, held = [], [], 0
    live, step = np.arange(len(key)), 0

    def compress() -> None:
        nonlocal held
        a, b = np.concatenate(a_out), np.concatenate(b_out)
        nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
        root = _forest(index[: len(a)], index[len(a) :], len(nodes))
        moved = root != np.arange(len(nodes))
        a_out[:], b_out[:] = [nodes[moved]], [nodes[root[moved]]]
        held = 0

    while len(live):
        step += 1
        live = live[live + step < len(key)]
        other = live + step
        near = (key[other] == key[live]) & (table[other, 0] - table[live, 0] <= max_bits)
        live = live[near]
        a, b = live, live + step
        for p in range(1, table.shape[1], 5):  # a few coordinates at a time
            ok = (np.abs(table[a, p : p + 5] - table[b, p : p + 5]) <= max_bits).all(axis=1)
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(bits[a] ^ bits[b]) <= max_bits
        if ok.any():
            a_out.append(a[ok])
            b_out.append(b[ok])
            held += int(ok.sum())
            if held > keep:
                compress()
    if not a_out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    compress()
    return order[a_out[0]], order[b_out[0]]


def links(nodes: DataFrame, count: int, max_bits: int = MAX_BITS, hot: int = HOT_BUCKET) -> DataFrame:
    """(a, b): links that connect exactly the nodes (``fp``) within ``max_bits`` of each other."""
    spark = nodes.sparkSession
    on_workers(spark)
    full = (1 << 64) - 1
    masks = block_masks(full, blocks_for(count, max_bits), max_bits)
    finer = [block_masks(full & ~m, max_bits + 2, max_bits) for m in masks]

    def mask_array(ms: list[int]):
        return F.array(*[F.lit(_signed(m)).cast("long") for m in ms])

    keyed = nodes.select("fp", F.posexplode(mask_array(masks)).alias("t", "mask")).select(
        "fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("k")
    )
    crowded = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("t", "k")
    usual = keyed.join(crowded, ["t", "k"], "left_anti").select(
        "fp", "t", F.lit(-1).alias("s"), F.col("k").alias("k"), F.lit(0).cast("long").alias("k2")
    )
    # What a crowded bucket's key leaves open differs in max_bits bits at most:
    # its rows meet again only where they agree on blocks of those bits.
    finer_column = F.array(*[mask_array(ms) for ms in finer])
    split = (
        keyed.join(crowded, ["t", "k"])
        .select("fp", "t", "k", F.posexplode(F.element_at(finer_column, F.col("t") + 1)).alias("s", "mask"))
        .select("fp", "t", "s", "k", F.col("fp").bitwiseAND(F.col("mask")).alias("k2"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        fp = rows.column("fp").to_numpy().view(np.uint64)
        columns = [rows.column(c).to_numpy() for c in ("t", "s", "k", "k2")]
        fresh = np.ones(len(fp), bool)
        fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        a, b = linked(np.cumsum(fresh), fp, max_bits)
        if len(a):
            pairs = np.unique(np.stack((fp[a], fp[b]), axis=1), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    met = usual.unionAll(split).repartition("t", "s", "k", "k2")
    return met.sortWithinPartitions("t", "s", "k", "k2").mapInArrow(run, "a long, b long")


def grouped(fingerprinted: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id) for the distinct fingerprints of a written (doc_id, fp) table.

    ``root`` is the smallest fingerprint of the component, ``component_id`` the
    smallest doc_id of its documents (null if none has an id).
    """
    nodes = stage(fingerprinted.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    rooted = components(links(nodes.select("fp"), nodes.count(), max_bits))
    # A node without links is its own root.
    roots = nodes.join(rooted, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    # written, so that both sides of the join below are plain shuffles and a large component can be split
    least = stage(roots.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    return roots.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``.

    Defined cases: null and empty texts have fingerprint zero and link like any
    other; repeated rows are all returned; rows with a null id take part and are
    returned, but a component's id is the smallest id that is not null; an empty
    table gives an empty result; other columns, whatever their names, are not
    read.
    """
    # a small table: rebalanced into few files instead of one per input split
    printed = with_fingerprint(pick(docs, "doc_id", "text"), size).select("doc_id", "fp")
    printed = stage(printed.hint("rebalance"), "simhash")
    return printed.join(grouped(printed, max_bits), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_each(docs: DataFrame, size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row per near-duplicate component: that of its smallest doc_id.

    Same cases as ``near_duplicates``. Of rows that share that smallest id
    (repeated ids) the one with the smallest text hash stays, of equal rows one;
    rows without ids come last.
    """
    docs = unclash(docs, ("doc_id", "text"), ("fp", "ll_hash"))
    slim = with_fingerprint(docs.select("doc_id", "text"), size)
    slim = slim.groupBy("doc_id", "fp", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    slim = stage(slim, "simhash")
    groups = grouped(slim.select("doc_id", "fp"), max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h", "n")
    best = slim.join(groups, "fp").groupBy("root").agg(F.min(order).alias("first"))
    best = best.select(F.col("first.doc_id").alias("id"), F.col("first.h").alias("h"), F.col("first.n").alias("n"))
    best = stage(best, "representatives")
    hashed = docs.withColumn("ll_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("ll_hash") == F.col("h"))
    kept = hashed.join(best, same, "left_semi")
    if best.where("n > 1").head(1):  # equal rows among them
        kept = kept.dropDuplicates(["doc_id", "ll_hash"])
    return kept.select(*docs.columns)
