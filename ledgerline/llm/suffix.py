"""Exact-substring dedup by a hash-compared suffix sort.

A byte is removed if it lies in a string of ``length`` bytes that also starts
earlier (smaller doc_id, or earlier in the same document). Equal strings must
meet without sending every suffix of the corpus around:

1. Prefix polynomial hashes give the hash of every ``GRAM``-byte gram at once.
   Each window of ``length`` bytes is owned by its (leftmost) smallest gram, so
   equal windows are owned by equal grams at equal places. Windows in a row
   with one owner make a context; contexts, a few per hundred bytes, travel by
   their owner's gram as two hashes and a place.
2. A context equal to an earlier one of its gram goes whole. Owners seen once
   are done with. First contexts of a gram that has several different ones
   fetch their bytes.
3. There the suffixes that start the windows are merge-sorted per gram and place.
   Two suffixes are compared by their common extension, found by binary search
   over prefix hashes, so a comparison takes a logarithmic number of steps.
   Neighbours that agree over ``length`` bytes are verified byte by byte.

Copies inside a task are resolved before the shuffle. A first pass over all
documents counts the rows that each gram would bring (``hot_grams``); grams over
a bound are dealt out by their windows instead, so a gram's rows that meet in one
task are bounded. Which path a window takes does not change the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import on_workers, pick, slices
from ledgerline.llm.textvec import Prefix, mix, utf8
from ledgerline.plans.materialize import stage

LENGTH = 100
GRAM = 32
#: Grams that bring so many rows, and at least one in 2**HOT_SHARE of all rows, are dealt out by window: 2**HOT_SHARE of
#: them at most, 8 MB of keys.
HOT_ROWS = 768
HOT_SHARE = 20
#: Owners gathered in a task before copies among them are resolved.
LOCAL_OWNERS = 1 << 18

_U = np.uint64


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def owners(
    gram: np.ndarray, offsets: np.ndarray, length: int, size: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of a slice: text, first window, last window, owner (places in the slice).

    The owner of a window is the leftmost smallest of its grams. A new context
    begins at a text's first window, where the smallest gram changes, and behind
    a window that starts with its own smallest gram (which then leaves).
    """
    width = length - size + 1
    empty = np.zeros(0, np.int64)
    if len(gram) < width:
        return empty, empty, empty, empty
    least = sliding_min(gram, width)
    own = gram[: len(least)] == least
    n = np.maximum(np.diff(offsets) - length + 1, 0)  # windows of each text
    text = np.flatnonzero(n)
    if not len(text):
        return empty, empty, empty, empty
    begin = np.zeros(len(least) + 1, bool)
    begin[1:-1] = least[1:] != least[:-1]
    begin[1:] |= own
    begin[offsets[text]] = True
    valid = np.zeros(len(least) + 1, np.int8)
    np.add.at(valid, offsets[text], 1)
    np.add.at(valid, offsets[text] + n[text], -1)
    valid = np.cumsum(valid[:-1]) > 0
    first = np.flatnonzero(begin[:-1] & valid)
    of_text = np.searchsorted(offsets, first, "right") - 1
    last = np.empty(len(first), np.int64)
    last[:-1] = first[1:] - 1
    last[-1] = len(least)
    last = np.minimum(last, offsets[of_text] + n[of_text] - 1)
    owner = last.copy()
    search = np.flatnonzero(~own[last])
    view = np.lib.stride_tricks.sliding_window_view(gram, width)
    for i in range(0, len(search), 1 << 16):
        part = search[i : i + (1 << 16)]
        owner[part] = first[part] + np.argmin(view[first[part]], axis=1)
    return of_text, first, last, owner


def contexts(texts: pa.Array, length: int, size: int, hot: np.ndarray):
    """Rows (text, lo, hi, owner's place, key, digest) of a slice; places are within the text.

    ``key`` hashes the owner's gram, ``digest`` all bytes of the context's
    windows. Contexts of a hot gram are taken apart into single windows whose
    key hashes the window itself.
    """
    data, offsets = utf8(texts)
    one, two = Prefix(data, 0), Prefix(data, 1)
    gram = mix(one.grams(size))
    text, first, last, owner = owners(gram, offsets, length, size)
    key = gram[owner]
    if len(hot) and len(key):
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        is_hot = hot[at] == key
        if is_hot.any():
            t, f, n = text[is_hot], first[is_hot], (last - first + 1)[is_hot]
            window = np.repeat(f - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own_key = mix(one.of(window, window + length)) ^ _U(0x5851F42D4C957F2D)
            keep = ~is_hot
            text = np.concatenate((text[keep], np.repeat(t, n)))
            first, last = np.concatenate((first[keep], window)), np.concatenate((last[keep], window))
            owner, key = np.concatenate((owner[keep], window)), np.concatenate((key[keep], own_key))
    digest = mix(two.of(first, last + length) + ((last - first) * 128 + owner - first).astype(_U))
    start = offsets[text]
    return text, first - start, last - start, owner - first, key, digest


ANCHORS = "gram long, digest long, uid long, place long"
#: ``place``: lo << 16 | (hi - lo) << 8 | (owner - lo); an interval found inside a task has
#: _INTERVAL added, a random gram (any task will do) and its end in place of the digest.
_INTERVAL = 1 << 62


def _first_of(columns: list[np.ndarray]) -> np.ndarray:
    """Which rows differ from the row before in any of the sorted columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _intervals(uid: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching intervals of a document merged."""
    order = np.lexsort((lo, uid))
    uid, lo, end = uid[order], lo[order], end[order]
    if not len(uid):
        return uid, lo, end
    # running maximum of the ends within a document
    document = np.cumsum(_first_of([uid])) - 1
    span = int(end.max()) + 1
    reach = np.maximum.accumulate(end + document * span) - document * span
    new = np.ones(len(uid), bool)
    new[1:] = (uid[1:] != uid[:-1]) | (lo[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return uid[at], lo[at], reach[np.append(at[1:], len(uid)) - 1]


def _held(batches: Iterator[pa.RecordBatch], length: int, size: int, hot: np.ndarray):
    """Sorted contexts of (uid, text) rows, LOCAL_OWNERS or a little more at a time: key, digest, uid, place, first.

    ``first`` tells the first context of each (key, digest); the others are copies of it.
    """
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush() -> tuple[np.ndarray, ...]:
        nonlocal count
        key, digest, uid, place = (np.concatenate(c) for c in zip(*held))
        held.clear()
        count = 0
        order = np.lexsort((place, uid, digest, key))
        key, digest, uid, place = key[order], digest[order], uid[order], place[order]
        return key, digest, uid, place, _first_of([key, digest])

    for batch in batches:
        for a, b in slices(batch.column(1)):
            part = batch.slice(a, b - a)
            text, lo, hi, owner, key, digest = contexts(part.column(1), length, size, hot)
            uid = part.column(0).to_numpy(zero_copy_only=False)[text]
            held.append((key, digest, uid, lo << 16 | (hi - lo) << 8 | owner))
            count += len(key)
            if count >= LOCAL_OWNERS:
                yield flush()
    if count:
        yield flush()


def _anchors(length: int, size: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, digest, uid, place, first in _held(batches, length, size, hot):
            again = ~first
            lo = place[again] >> 16
            end = lo + (place[again] >> 8 & 255) + length
            u, lo, end = _intervals(uid[again], lo, end)
            spread = mix(u.astype(_U) ^ mix(lo.astype(_U)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((key[first], spread)).view(np.int64)),
                    pa.array(np.concatenate((digest[first].view(np.int64), end))),
                    pa.array(np.concatenate((uid[first], u))),
                    pa.array(np.concatenate((place[first], (lo << 16) + _INTERVAL))),
                ],
                names=["gram", "digest", "uid", "place"],
            )

    return run


SHARED = "uid long, lo long, end long, gram long, owner int"


def _shared(length: int):
    """Per gram: what goes whole (owner -1), and the first contexts that need their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        gram, digest, uid, place = (rows.column(i).to_numpy() for i in range(4))
        known = place >= _INTERVAL
        out = [(uid[known], place[known] - _INTERVAL >> 16, digest[known], np.zeros(known.sum(), np.int64),
                np.full(known.sum(), -1, np.int64))]
        gram, digest, uid, place = (c[~known] for c in (gram, digest, uid, place))
        order = np.argsort(gram, kind="stable")
        sorted_gram = gram[order]
        twin = np.zeros(len(order), bool)
        twin[1:] = sorted_gram[1:] == sorted_gram[:-1]
        twin[:-1] |= twin[1:]
        order = order[twin]  # grams with one context are done with
        gram, digest, uid, place = (c[order] for c in (gram, digest, uid, place))
        order = np.lexsort((place, uid, digest, gram))
        gram, digest, uid, place = (c[order] for c in (gram, digest, uid, place))
        first = _first_of([gram, digest]) if len(gram) else np.zeros(0, bool)
        lo = place >> 16
        end = lo + (place >> 8 & 255) + length
        again = ~first
        out.append((uid[again], lo[again], end[again], np.zeros(again.sum(), np.int64), np.full(again.sum(), -1, np.int64)))
        f = np.flatnonzero(first)
        several = np.zeros(len(f), bool)
        several[1:] = gram[f][1:] == gram[f][:-1]
        several[:-1] |= several[1:]
        f = f[several]
        out.append((uid[f], lo[f], end[f], gram[f], place[f] & 255))
        done = [np.concatenate(c) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c.astype(np.int64)) for c in done[:4]), pa.array(done[4].astype(np.int32))],
            names=["uid", "lo", "end", "gram", "owner"],
        )

    return run


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, text, list of contexts) -> (gram, uid, lo, owner, body)."""
    for batch in batches:
        for row in range(batch.num_rows):
            text = batch.column(1)[row].as_buffer().to_pybytes()
            lists = batch.column(2)[row].values
            lo, end = lists.field("lo").to_pylist(), lists.field("end").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    lists.field("gram"),
                    pa.array([batch.column(0)[row].as_py()] * len(lo), pa.int64()),
                    lists.field("lo"),
                    lists.field("owner"),
                    pa.array([text[a:b] for a, b in zip(lo, end)], pa.binary()),
                ],
                names=["gram", "uid", "lo", "owner", "body"],
            )


class Suffixes:
    """Suffixes of a byte array, compared over their first ``length`` bytes by hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.hash = Prefix(data, 0)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, up to ``length``."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length)
        for _ in range(self.length.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.hash.of(x, x + middle) == self.hash.of(y, y + middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether suffix x sorts before suffix y; equal ones by their place in the array."""
        n = self.common(x, y)
        equal = n >= self.length
        at = np.where(equal, 0, n)
        return np.where(equal, x < y, self.data[x + at] < self.data[y + at])

    def sort(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes, sorted within each run of equal ``group``: a bottom-up merge sort.

        All merges of a level run side by side: each suffix finds its rank in
        the neighbouring sorted run by binary search.
        """
        n = len(start)
        order = np.arange(n)
        head = np.flatnonzero(_first_of([group])) if n else np.zeros(0, np.int64)
        stop = np.append(head[1:], n)
        number = np.cumsum(_first_of([group])) - 1 if n else head
        place = np.arange(n) - head[number] if n else head
        limit = stop[number] if n else head
        largest = int((stop - head).max()) if n else 0
        width = 1
        while width < largest:
            # runs of ``width`` within a group; a run meets its sibling
            run = place // width
            sibling = head[number] + (run ^ 1) * width
            active = np.flatnonzero(sibling < limit)
            low = sibling[active].copy()
            high = np.minimum(sibling[active] + width, limit[active])
            mine = start[order[active]]
            base = low.copy()
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                smaller = self.before(start[order[middle]], mine[open_])
                low[open_] = np.where(smaller, middle + 1, low[open_])
                high[open_] = np.where(smaller, high[open_], middle)
            rank = low - base
            pair = head[number[active]] + (run[active] // 2) * 2 * width
            target = np.arange(n)
            target[active] = pair + place[active] % width + rank
            moved = np.empty(n, np.int64)
            moved[target] = order
            order = moved
            width *= 2
        return order


def _same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(x), bool)
    step = np.arange(length)
    for i in range(0, len(x), 1 << 15):
        a, b = x[i : i + (1 << 15), None] + step, y[i : i + (1 << 15), None] + step
        out[i : i + (1 << 15)] = (data[a] == data[b]).all(axis=1)
    return out


def repeated_windows(
    data: np.ndarray, begin: np.ndarray, size: np.ndarray, owner: np.ndarray, gram: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Windows that equal one of an earlier context: (context, window within it).

    Contexts are given in document order by where they begin in ``data``, their
    size, their owner's place and gram.
    """
    n = size - length + 1
    context = np.repeat(np.arange(len(begin)), n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = begin[context] + window
    ahead = owner[context] - window  # the owner's place in the window
    order = np.lexsort((start, ahead, gram[context]))
    context, window, start, ahead = (c[order] for c in (context, window, start, ahead))
    new = _first_of([gram[context], ahead]) if len(order) else np.zeros(0, bool)
    group = np.cumsum(new)
    alone = new & np.append(new[1:], True) if len(new) else new
    context, window, start, group = (c[~alone] for c in (context, window, start, group))
    suffixes = Suffixes(data, length)
    order = suffixes.sort(start, group)
    here, above = order[1:], order[:-1]
    twin = group[here] == group[above]
    here, above = here[twin], above[twin]
    twin = suffixes.common(start[above], start[here]) >= length
    here, above = here[twin], above[twin]
    verified = _same_bytes(data, start[above], start[here], length)
    if not verified.all():  # unequal strings of equal hash: settle their groups by the bytes themselves
        odd = np.isin(group, np.unique(group[here[~verified]]))
        keep = ~odd[here]
        exact: dict[tuple[int, bytes], int] = {}
        extra = []
        for i in np.flatnonzero(odd)[np.argsort(start[odd], kind="stable")].tolist():
            text = (int(group[i]), data[start[i] : start[i] + length].tobytes())
            if exact.setdefault(text, i) != i:
                extra.append(i)
        here = np.concatenate((here[keep], np.array(extra, np.int64)))
    return context[here], window[here]


def _sorted_suffixes(length: int):
    """Contexts with their bytes -> intervals to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        gram, uid, lo, owner = (rows.column(i).to_numpy() for i in range(4))
        order = np.lexsort((lo, uid, gram))
        body = rows.column(4).combine_chunks().cast(pa.large_binary()).take(pa.array(order))
        gram, uid, lo, owner = (c[order].astype(np.int64) for c in (gram, uid, lo, owner))
        cuts = np.concatenate(([0], np.flatnonzero(_first_of([gram]))[1:], [len(gram)]))
        sizes = pa.compute.binary_length(body).to_numpy()
        total = np.concatenate(([0], np.cumsum(sizes)))
        a = 0
        while a < len(gram):  # whole grams, about half a megabyte at a time
            reach = np.searchsorted(total, total[a] + (1 << 19))
            b = int(cuts[min(np.searchsorted(cuts, max(reach, a + 1)), len(cuts) - 1)])
            joined = b"".join(body.slice(a, b - a).to_pylist())
            data = np.frombuffer(joined, np.uint8)
            begin = total[a:b] - total[a]
            context, window = repeated_windows(data, begin, sizes[a:b], owner[a:b], gram[a:b], length)
            at = lo[a:b][context] + window
            u, start, end = _intervals(uid[a:b][context], at, at + length)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(start), pa.array(end)], names=["uid", "lo", "end"])
            a = b

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, intervals) -> the kept bytes and what was removed."""
    for batch in batches:
        out = [[], [], [], [], []]
        for row in range(batch.num_rows):
            text = batch.column(1)[row]
            body = text.as_buffer().to_pybytes() if text.is_valid else b""
            lists = batch.column(2)[row]
            spans = []
            if lists.is_valid:
                lo, end = (lists.values.field(f).to_numpy() for f in ("lo", "end"))
                _, lo, end = _intervals(np.zeros(len(lo), np.int64), lo, end)
                spans = list(zip(lo.tolist(), end.tolist()))
            kept, at = [], 0
            for a, b in spans:
                kept.append(body[at:a])
                at = b
            kept = b"".join([*kept, body[at:]])
            for column, v in zip(out, (len(body), len(body) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)):
                column.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def _numbered(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, text): uid is unique per document and ordered like doc_id.

    Unique ids serve as they are. Otherwise the distinct (id, text) pairs are
    numbered in order over range partitions, nulls first.
    """
    docs = pick(docs, "doc_id", "text")
    n, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if n == ids:
        return docs.select(F.col("doc_id").alias("uid"), "doc_id", "text")
    keyed = docs.withColumn("h", F.xxhash64("text"))
    order = keyed.select("doc_id", "h").distinct().repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    uids = stage(order.withColumn("uid", F.monotonically_increasing_id()), "document-order").toDF("i", "g", "uid")
    match = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))
    return stage(keyed.join(uids, match).select("uid", "doc_id", "text"), "numbered")


def hot_grams(docs: DataFrame, length: int, size: int) -> np.ndarray:
    """Keys of the grams that bring very many rows to the shuffle, counted over all documents.

    A task counts a gram's different contexts in each of its fillings of
    LOCAL_OWNERS and reports those of two or more, so a gram's count lacks at most
    one row per filling. Every gram with ``least`` rows more than there are
    fillings is found, where ``least`` is HOT_ROWS or, beyond that, one in
    2**HOT_SHARE of all rows; so at most 2**HOT_SHARE are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, _U)
        for key, _, _, _, first in _held(batches, length, size, none):
            key = key[first]
            begin = np.flatnonzero(_first_of([key]))
            n = np.diff(np.append(begin, len(key)))
            many = n > 1
            gram = pa.array(np.append(key[begin[many]].view(np.int64), 0), mask=np.append(np.zeros(many.sum(), bool), True))
            yield pa.RecordBatch.from_arrays([gram, pa.array(np.append(n[many], len(key)))], names=["gram", "n"])

    counts = docs.select("uid", "text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = stage(counts.where(F.col("gram").isNull() | (F.col("n") >= HOT_ROWS)), "hot-grams")  # null: all rows
    total = counts.where(F.col("gram").isNull()).agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("gram").isNotNull() & (F.col("n") >= max(HOT_ROWS, total >> HOT_SHARE))).select("gram")
    return np.sort(hot.toArrow().column(0).to_numpy().view(_U))  # at most 2**HOT_SHARE keys


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the ``kept`` bytes of every document.

    Removed is every byte inside a ``length``-byte string (at most 255) that also
    starts earlier; all strings are judged on the input.

    Defined cases: null and empty texts, and texts shorter than ``length``, lose
    nothing; rows equal in id and text count as one document and are all
    returned; rows of equal id are ordered by a hash of their text, rows without
    id come first; an empty table gives an empty result; other columns, whatever
    their names, are not read.
    """
    if not gram <= length <= 255:
        raise ValueError("length must be between the gram size and 255 bytes")
    on_workers(docs.sparkSession)
    docs = _numbered(docs)
    hot = hot_grams(docs, length, gram)
    anchors = docs.select("uid", "text").mapInArrow(_anchors(length, gram, hot), ANCHORS)
    found = stage(anchors.repartition("gram").mapInArrow(_shared(length), SHARED), "shared-contexts")

    wanted = F.collect_list(F.struct("lo", "end", "gram", "owner")).alias("contexts")
    several = found.where("owner >= 0").groupBy("uid").agg(wanted).withColumnRenamed("uid", "u")
    bodies = docs.join(several, F.col("uid") == F.col("u")).select("uid", "text", "contexts")
    bodies = bodies.mapInArrow(_bytes_of, "gram long, uid long, lo long, owner int, body binary")
    fine = bodies.repartition("gram").mapInArrow(_sorted_suffixes(length), "uid long, lo long, end long")

    spans = found.where("owner < 0").select("uid", "lo", "end").unionAll(fine)
    spans = spans.groupBy("uid").agg(F.collect_list(F.struct("lo", "end")).alias("spans")).withColumnRenamed("uid", "u")
    cut = docs.join(spans, F.col("uid") == F.col("u"), "left").select("doc_id", "text", "spans")
    return cut.mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
