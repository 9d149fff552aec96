"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences. Five-word seeds that a
document shares with an item make a candidate pair; a pair whose seeds could
cover enough of the item is tiled: the longest common run of words that are
still free on both sides is found by Karp-Rabin hashes, verified word by word
and marked, again and again, with falling search lengths. The tiles' share of
the item's words is the coverage. Order plays no part in it, so a passage whose
sentences were rearranged is caught as well.

The benchmark is the query set: it is read in blocks of bounded size, equal items
once, and every block meets all documents inside their own partitions. No
document is shuffled, and a passage that a third of all documents share costs
each of them its own tiling only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import add_columns, on_workers, pick, slices, unclash
from ledgerline.llm.textvec import Prefix, mix, spans, utf8, windows
from ledgerline.plans.materialize import stage

SEED_WORDS = 5
COVERAGE = 0.8
#: Benchmark text in one block; a block is sent to every task.
BLOCK_BYTES = 4 << 20
FIRST_LENGTH = 20  # search length that the tiling starts with

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of all words (lower-cased letters and digits) and their text numbers."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends, text = spans(_WORD[data], offsets)
    return mix(Prefix(data).of(starts, ends) + (ends - starts).astype(np.uint64)), text, len(offsets) - 1


_BASE, _MOD = 1_000_003, (1 << 61) - 1


def _prefix(seq: list[int]) -> list[int]:
    out = [0]
    for x in seq:
        out.append((out[-1] * _BASE + x) % _MOD)
    return out


def tiles(doc: list[int], item: list[int], least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length), longest first.

    No word of either side lies in two tiles; every tile has ``least`` words or
    more. Ties go to the earliest place in the item, then in the document.
    """
    doc_hash, item_hash = _prefix(doc), _prefix(item)
    free_doc, free_item = [True] * len(doc), [True] * len(item)
    out: list[tuple[int, int, int]] = []

    def scan(length: int) -> list[tuple[int, int, int]]:
        """Maximal free matches of at least ``length`` words."""
        top = pow(_BASE, length, _MOD)
        places: dict[int, list[int]] = {}
        run = 0
        for i, free in enumerate(free_doc):
            run = run + 1 if free else 0
            if run >= length:
                h = (doc_hash[i + 1] - doc_hash[i + 1 - length] * top) % _MOD
                places.setdefault(h, []).append(i + 1 - length)
        found, run = [], 0
        for j, free in enumerate(free_item):
            run = run + 1 if free else 0
            if run < length:
                continue
            p = j + 1 - length
            h = (item_hash[j + 1] - item_hash[p] * top) % _MOD
            for d in places.get(h, ()):
                if p and d and free_item[p - 1] and free_doc[d - 1] and item[p - 1] == doc[d - 1]:
                    continue  # part of a match that starts earlier
                n = 0
                while (
                    p + n < len(item) and d + n < len(doc)
                    and free_item[p + n] and free_doc[d + n] and item[p + n] == doc[d + n]
                ):
                    n += 1
                if n >= length:  # else the hashes agreed by chance
                    found.append((p, d, n))
        return found

    length = max(least, min(FIRST_LENGTH, len(item)))
    while True:
        found = scan(length)
        longest = max((n for _, _, n in found), default=0)
        if longest > 2 * length:
            length = longest
            continue
        again = False
        for p, d, n in sorted(found, key=lambda t: (-t[2], t[0], t[1])):
            if all(free_item[p : p + n]) and all(free_doc[d : d + n]):
                out.append((p, d, n))
                free_item[p : p + n] = [False] * n
                free_doc[d : d + n] = [False] * n
            else:
                again = True  # what is left of it may still be a match
        if again:
            continue
        if length == least:
            return out
        length = max(least, length // 2)


class Benchmark:
    """The seeds of a block of benchmark items."""

    def __init__(self, ids: list, texts: list[str]):
        word, text, count = words(pa.array(texts, pa.string()))
        bounds = np.searchsorted(text, np.arange(count + 1))
        self.ids = ids
        self.items = [word[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        self.lengths = np.diff(bounds)
        at, key = windows(word, text, SEED_WORDS)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], text[at][order], (at - bounds[text[at]])[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def candidates(self, word: np.ndarray, text: np.ndarray):
        """(document, item, word positions in the slice) whose seeds could cover enough."""
        at, key = windows(word, text, SEED_WORDS)
        maybe = self.bits[(key & np.uint64((1 << 20) - 1)).astype(np.int64)]
        at, key = at[maybe], key[maybe]
        hit = np.searchsorted(self.key, key, "right") > np.searchsorted(self.key, key, "left")
        at, key = at[hit], key[hit]
        if not len(at):
            return
        # A document's different seeds decide which items they could cover; the
        # places of repeated ones are looked up for the pairs that are left.
        order = np.lexsort((key, text[at]))
        at, key = at[order], key[order]
        owner = text[at]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
        seeds, docs = key[fresh], owner[fresh]
        low = np.searchsorted(self.key, seeds, "left")
        size = np.searchsorted(self.key, seeds, "right") - low
        seed = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        pair = np.repeat(docs, size) * len(self.ids) + self.item[seed]
        order = np.argsort(pair, kind="stable")
        pair, seed = pair[order], seed[order]
        cuts = np.concatenate(([0], np.flatnonzero(pair[1:] != pair[:-1]) + 1, [len(pair)]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            doc, item = divmod(int(pair[a]), len(self.ids))
            covered = np.zeros(self.lengths[item], bool)
            for j in range(SEED_WORDS):
                covered[self.place[seed[a:b]] + j] = True
            if covered.sum() >= COVERAGE * self.lengths[item]:
                mine = slice(*np.searchsorted(owner, (doc, doc + 1)))
                yield doc, item, np.sort(at[mine][np.isin(key[mine], self.key[seed[a:b]])])


def _near(word: np.ndarray, at: np.ndarray) -> list[int]:
    """The document's words inside its seeds; what lies between becomes one stranger."""
    inside = np.unique((at[:, None] + np.arange(SEED_WORDS)).ravel())
    out, last = [], None
    for i in inside.tolist():
        if last is not None and i != last + 1:
            out.append(-1)
        out.append(int(word[i]))
        last = i
    return out


_benchmarks: dict[int, Benchmark] = {}  # of the task's block, by hash; a worker keeps the last one


def held(column: pa.Array, ids: list, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(document's row, item's number, item's words, covered words, tiles) of the contaminated pairs."""
    key = hash((tuple(ids), tuple(texts)))
    if key not in _benchmarks:
        _benchmarks.clear()
        _benchmarks[key] = Benchmark(ids, texts)
    bench = _benchmarks[key]
    word, text, _ = words(column)
    for doc, item, at in bench.candidates(word, text):
        made = tiles(_near(word, at), bench.items[item])
        n, covered = len(bench.items[item]), sum(t[2] for t in made)
        if covered >= COVERAGE * n:
            yield doc, item, n, covered, len(made)


PAIR_SCHEMA = (
    "doc_id long, item_id long, n_item_words int, n_covered int, n_tiles int, coverage double, contaminated boolean"
)


def _against(docs: DataFrame, block: list) -> DataFrame:
    ids = [r["item_id"] for r in block]
    texts = [r["text"] for r in block]
    times = [r["n"] for r in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                rows = [
                    (part.column(0)[doc].as_py(), ids[item], n, covered, count, covered / n, True, times[item])
                    for doc, item, n, covered, count in held(part.column(1), ids, texts)
                ]
                if rows:
                    types = [
                        pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.int64()
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                        names=[*(f.split()[0] for f in PAIR_SCHEMA.split(", ")), "n"],
                    )

    found = docs.mapInArrow(run, PAIR_SCHEMA + ", n long")
    if max(times) > 1:  # a repeated item gives its rows again
        found = found.withColumn("again", F.explode(F.expr("array_repeat(1, CAST(n AS INT))"))).drop("again")
    return found.drop("n")


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """The items with a text, equal ones as one row with their number ``n``, in blocks of about ``block_bytes``."""
    items = pick(benchmark, "item_id", "text").where(F.col("text").isNotNull())
    items = items.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("n"))
    items = stage(items.withColumn("bytes", F.octet_length("text").cast("long") + 32), "benchmark-items")
    blocks = max(1, math.ceil((items.agg(F.sum("bytes")).first()[0] or 0) / block_bytes))
    in_block = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        rows = in_block.where(F.col("block") == b).select("item_id", "text", "n").orderBy("item_id", "text").collect()
        if rows:
            yield rows


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and benchmark item that it holds (coverage of 0.8 or more).

    Defined cases: null, empty and short texts (under five words) on either side
    give no row; a repeated document or item gives its rows again; ids may be
    null; an empty table on either side gives an empty result; other columns,
    whatever their names, are not read.
    """
    on_workers(docs.sparkSession)
    docs = pick(docs, "doc_id", "text")
    out = None
    for block in benchmark_blocks(benchmark, block_bytes):
        found = _against(docs, block)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], PAIR_SCHEMA) if out is None else out


def with_verdict(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``contaminated``: whether the text holds any benchmark item.

    Decided row by row inside the partitions, one pass per block of the
    benchmark, so rows without an id or with a repeated one are judged by their
    own text. Same cases as ``contaminated_pairs``; an input column named
    ``contaminated`` is replaced.
    """
    out = unclash(docs, ("text",), ("contaminated", "ll_found")).withColumn("contaminated", F.lit(False))
    schema = T.StructType([T.StructField("ll_found", T.BooleanType(), False)])
    names = out.columns
    for block in benchmark_blocks(benchmark, block_bytes):
        ids, texts = [r["item_id"] for r in block], [r["text"] for r in block]

        def found(column: pa.Array, ids=ids, texts=texts) -> dict[str, pa.Array]:
            holds = np.zeros(len(column), bool)
            for doc, *_ in held(column, ids, texts):
                holds[doc] = True
            return {"ll_found": pa.array(holds)}

        out = add_columns(out, "text", schema, found)
        out = out.withColumn("contaminated", F.col("contaminated") | F.col("ll_found")).select(*names)
    return out
