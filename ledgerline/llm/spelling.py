"""Spelling variant grouping with a variable-length gram index.

Words one edit apart are found without comparing all words:

1. Gram dictionary. All grams of ``Q_MIN`` to ``Q_MAX`` characters of the distinct
   words (between an opening and a closing mark) are counted; the frequent ones
   are the dictionary of grams that are too common to stand alone.
2. Decomposition. From every position a word takes the shortest gram that is not
   in the dictionary (at most ``Q_MAX`` characters), so grams are long where
   letters are common. Which gram a position gets depends on the gram's own
   characters only, so an edit changes just the grams that contain it.
3. Bounds. A word's bound is the largest number of its grams that one edit can
   touch. Two near words share all others, at positions at most one apart. Sorted
   by one global order (rarest first), the first of the shared grams stands among
   the first bound + 1 of either word: only these enter the index's lists.
4. Merging. Lists are keyed by gram, word length and position; words meet in a
   list of their own length, or of the length and position that one inserted
   character leaves. The pairs that meet are verified by their edit distance.

A word's form is its near word of largest count if that is at least twice its
own; forms are followed by pointer doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import on_workers, pick, release_memory, slices
from ledgerline.llm.textvec import Prefix, mix, spans, utf8
from ledgerline.plans.materialize import stage

LEAST_LENGTH = 5
LEAST_COUNT = 3
ERASE_EVERY = 97  # of (document, word) pairs one in so many loses a character
TIMES = 2  # a form is at least so many times as frequent

Q_MIN, Q_MAX = 2, 5
OPENING, CLOSING = "^", "$"  # no word holds them
#: Most grams in the dictionary; it goes to every task.
DICTIONARY_GRAMS = 1 << 16
#: Grams in fewer places never enter the dictionary.
LEAST_FREQUENT = 16

_SLICE_BYTES = 2 << 20
_VECTOR_BYTES = 64  # longer words are hashed one by one

_ASCII = np.zeros(256, bool)
_ASCII[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and one more
_OUTSIDE = re.compile(rb"[\x00-@\[-`{-\x7f\xc2\xc4-\xf4]")  # bytes that start a character which is in no word


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32_ranges(before: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges, each continued from the CRC-32 ``before`` it."""
    crc = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    n = ends - starts
    order = np.argsort(-n, kind="stable")
    long = int(np.searchsorted(-n[order], -_VECTOR_BYTES))
    for i in order[:long]:
        crc[i] = zlib.crc32(data[starts[i] : ends[i]], int(before[i])) ^ 0xFFFFFFFF
    order = order[long:]
    lengths = n[order]
    for j in range(int(lengths[0]) if len(lengths) else 0):
        order = order[: np.searchsorted(-lengths, -j)]
        now = crc[order]
        crc[order] = _CRC[(now ^ data[starts[order] + j]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, text numbers) of a slice; a single long text comes in pieces cut outside words."""
    numbers = np.arange(len(offsets) - 1)
    at = 0
    while len(numbers) == 1 and len(data) - at > 2 * _SLICE_BYTES:
        cut = _OUTSIDE.search(memoryview(data), at + _SLICE_BYTES)
        if not cut:
            break
        yield data[at : cut.start()], np.array([0, cut.start() - at]), numbers
        at = cut.start()
    yield data[at:], np.maximum(offsets - at, 0), numbers


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow string array."""
    n = ends - starts
    to = np.zeros(len(n) + 1, np.int32)
    np.cumsum(n, out=to[1:])
    body = data[np.repeat(starts - to[:-1], n) + np.arange(to[-1])]
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(body)))


def slice_words(ids: list, texts: pa.Array, least_length: int = LEAST_LENGTH, every: int = ERASE_EVERY):
    """(words, counts) of some documents: maximal letter runs, lower-cased, some with a character erased.

    A word is erased a character where ``every`` divides the CRC-32 of
    ``<id>:<word>``. Shorter results than ``least_length`` are left out.
    """
    data, offsets = utf8(texts)
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    for part, cuts, numbers in _pieces(data, offsets):
        low = _LOWER[part]
        lead = part == _LEAD
        inside = _ASCII[part] | lead
        inside[1:] |= lead[:-1]
        starts, ends, text = spans(inside, cuts)
        if not len(starts):
            continue
        crc = crc32_ranges(heads[numbers[text]], low, starts, ends)
        erased = crc % np.uint32(every) == 0
        wide = np.zeros(len(part) + 1, np.int32)
        np.cumsum(lead, out=wide[1:])
        length = ends - starts - (wide[ends] - wide[starts])
        made: Counter = Counter()
        for i in np.flatnonzero(erased & (length > least_length)):
            word = low[starts[i] : ends[i]].tobytes().decode()
            p = int(crc[i]) % len(word)
            made[word[:p] + word[p + 1 :]] += 1
        if made:
            yield pa.array(list(made), pa.string()), pa.array(list(made.values()), pa.int64())
        whole = np.flatnonzero(~erased & (length >= least_length))
        starts, ends = starts[whole], ends[whole]
        key = mix(Prefix(low).of(starts, ends) + (ends - starts).astype(np.uint64))
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        yield _gather(low, starts[first], ends[first]), pa.array(n, pa.int64())


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts with at least ``least_count`` occurrences.

    Words are counted inside a slice of texts first, then by Spark's partial
    and final aggregation, so a frequent word is one row per slice.
    """
    docs = pick(docs, "doc_id", "text")
    on_workers(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), _SLICE_BYTES):
                part = batch.slice(a, b - a)
                for words, n in slice_words(part.column(0).to_pylist(), part.column(1), least_length):
                    yield pa.RecordBatch.from_arrays([words, n], names=["word", "n"])
        release_memory()

    found = docs.mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _marked(word: str) -> str:
    return OPENING + word + CLOSING


def gram_dictionary(words: DataFrame, most: int = DICTIONARY_GRAMS, least: int = LEAST_FREQUENT) -> dict[str, int]:
    """The frequent grams and their counts: at most ``most``, whatever the words.

    A gram is frequent above a threshold that rises with the number of places
    where grams stand; no more than places / threshold grams can pass it.
    """
    size = words.agg(F.count(F.lit(1)).alias("w"), F.sum(F.length("word") + 2).alias("c")).first()
    lengths = Q_MAX - Q_MIN + 1
    threshold = max(least, (size["c"] or 0) * lengths // most)

    def run(batches):
        for batch in batches:
            n: Counter = Counter()
            for word in batch.column(0).to_pylist():
                s = _marked(word)
                for q in range(Q_MIN, Q_MAX + 1):
                    n.update([s[i : i + q] for i in range(len(s) - q + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["gram", "n"])

    counts = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in counts.where(F.col("n") > threshold).collect()}


def decompose(word: str, dictionary: dict[str, int]) -> list[str]:
    """A word's variable-length grams, one from every position of the marked word."""
    s = _marked(word)
    grams = []
    for i in range(len(s) - Q_MIN + 1):
        j = i + Q_MIN
        while j < len(s) and j - i < Q_MAX and s[i:j] in dictionary:
            j += 1
        grams.append(s[i:j])
    return grams


def affected(grams: list[str]) -> int:
    """The largest number of a word's grams that one edited character touches."""
    n = len(grams) - 1  # characters of the word, from 1 in the marked word
    step = [0] * (n + 3)
    for i, g in enumerate(grams):
        step[i] += 1
        step[i + len(g)] -= 1
    most = inside = 0
    for p in range(n + 1):
        inside += step[p]
        if p:
            most = max(most, inside)
    return most


def listed(word: str, dictionary: dict[str, int]) -> list[tuple[int, str]]:
    """(position, gram) of the lists that a word enters: its bound + 1 rarest grams."""
    grams = decompose(word, dictionary)
    order = sorted((dictionary.get(g, 0), g, i) for i, g in enumerate(grams))
    return [(i, g) for _, g, i in order[: affected(grams) + 1]]


def near_words(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every unordered pair of words exactly one edit apart, once.

    ``words`` has distinct words (word, n) of at least ``Q_MAX`` characters, so
    that one edit always leaves a shared gram.
    """
    words = words.select("word", "n")
    dictionary = gram_dictionary(words)

    def run(batches):
        for batch in batches:
            col = {"word": [], "n": [], "gram": [], "len": [], "pos": []}
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, g in listed(word, dictionary):
                    col["word"].append(word)
                    col["n"].append(n)
                    col["gram"].append(g)
                    col["len"].append(len(word))
                    col["pos"].append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(col["word"], pa.string()), pa.array(col["n"], pa.int64()), pa.array(col["gram"], pa.string()),
                 pa.array(col["len"], pa.int32()), pa.array(col["pos"], pa.int32())], names=list(col))

    # Written once: both sides of the join are then plain shuffles, so a long list can be split.
    lists = stage(words.mapInArrow(run, "word string, n long, gram string, len int, pos int"), "gram-lists")
    left = lists.select(F.xxhash64("gram", "len", "pos").alias("list"), F.col("word").alias("a"), F.col("n").alias("n_a"))

    def meeting(same: bool, length, pos):
        return F.struct(F.lit(same).alias("same"), F.xxhash64("gram", length, pos).alias("list"))

    shorter = F.col("len") - 1
    meets = F.explode(
        F.array(meeting(True, "len", "pos"), meeting(False, shorter, "pos"), meeting(False, shorter, F.col("pos") - 1))
    )
    right = lists.select(F.col("word").alias("b"), F.col("n").alias("n_b"), meets.alias("m")).select("b", "n_b", "m.*")
    met = left.join(right, "list").where((~F.col("same") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every row (word, form): the last word that following forms leads to.

    Pointers double each round, so a chain of length k takes about log2(k)
    rounds; a form is more frequent than its word, so chains end.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "form-roots")
    while True:
        step = now.select(F.col("word").alias("w"), F.col("root").alias("r"))
        moved = now.join(step, now["root"] == step["w"], "left")
        now = stage(moved.select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "form-roots")
        if not now.where("moved").head(1):
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of a document table.

    Defined cases: a null or empty text has no words; a null id counts as an
    empty one in the erasure rule; repeated rows count as often as they stand;
    of near words with equal counts the first in code-point order is the form;
    an empty table gives an empty result; extra columns are dropped. A run of
    letters of any length is one word.
    """
    if least_length < Q_MAX:
        raise ValueError(f"words need at least {Q_MAX} characters")
    words = stage(count_words(docs, least_length, least_count), "words")
    pairs = stage(near_words(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).unionAll(
        pairs.select("b", "a", "n_a")
    )
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("best")
    )
    chosen = -F.col("best.m") >= times * F.col("n")
    found = stage(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.m")).alias("form_n"),
        ),
        "word-forms",
    )
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
