"""Token ids in grammar-compressed shards (Re-Pair), readable document by document.

Documents are ordered by id over range partitions, encoded, and cut into blocks
of about a million ids, always between documents. Each block is compressed by
Re-Pair: rounds of replacing its most frequent adjacent id pairs by new symbols,
never across a document's end, until no pair occurs twice. A block is one row of
a Parquet file (written by Spark, so any store and its commit protocol will do)
with

    doc_id, first_symbol, n_ids   per document: id, place in ``symbols``, ids
    left, right                   the two symbols of rule 0, 1, ... (packed)
    length                        ids that a rule expands to (int32)
    n_symbols, symbols            what is left of the block (packed)

all little-endian. Packed are the low 16 bits of every number, then one plane of
bits for each higher bit that the block's largest symbol needs. A document is
decoded from its own symbols and the rules alone.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from ledgerline.llm.common import on_workers, pick, slices
from ledgerline.llm.textvec import SPACE, spans, utf8
from ledgerline.llm.unit_cache import UnitCache
from ledgerline.session import scratch_dir

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 1 << 20
HASHED = 1 << 16  # more pair positions than this are counted by hash buckets before they are sorted

_encoders: dict[int, WordEncoder] = {}  # by hash of the tokenizer's file; lives as long as the worker


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)  # ASCII punctuation but the apostrophe, which contractions need
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that the tokenizer treats independently: bytes, starts, ends, text numbers.

    Words between white space, cut further where a letter (ASCII or Latin-1)
    meets ASCII punctuation, since no token sequence spans that. A-Z is
    lower-cased, as the tokenizer would, unless combining marks are about, which
    compose with a capital before it is lowered; special-token markers (``<|``)
    forbid the further cuts.
    """
    starts, ends, text = spans(~SPACE[data], offsets)
    if not len(starts):
        return data, starts, ends, text
    if not np.isin(data, (0xCC, 0xCD)).any():
        data = _LOWER[data]
    mark = _MARK[data]
    if not ((data[:-1] == 60) & (data[1:] == 124)).any():
        latin = np.zeros(len(data), bool)
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[~np.isin(data[lead + 1], (0x97, 0xB7))]
        latin[lead] = latin[lead + 1] = True
        letter = _LETTER[data] | latin
        cut = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
        inside = np.searchsorted(starts, cut, "right") - 1
        cut, inside = (x[(cut > starts[inside]) & (cut < ends[inside])] for x in (cut, inside))
        text = np.concatenate((text, text[inside]))
        starts = np.concatenate((starts, cut))
        order = np.argsort(starts, kind="stable")
        starts, text = starts[order], text[order]
        ends = np.sort(np.concatenate((ends, cut)))
    return data, starts, ends, text


_SMALL = "".join(c for c in map(chr, range(256)) if c.isalpha() and c.islower())  # of Latin-1


def _plain(tokenizer: Tokenizer) -> Tokenizer:
    """For words of small Latin-1 letters: a copy of the tokenizer without normalizer and patterns.

    The tokenizer itself where those would change or cut such words.
    """
    words = [_SMALL, *_SMALL, "isn", "ll", "z" * 99]
    text = " ".join(words)
    if tokenizer.normalizer and tokenizer.normalizer.normalize_str(text) != text:
        return tokenizer
    copy = Tokenizer.from_str(tokenizer.to_str())
    copy.normalizer = normalizers.Sequence([])
    copy.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    own = tokenizer.pre_tokenizer.pre_tokenize_str(text) if tokenizer.pre_tokenizer else []
    return copy if own == copy.pre_tokenizer.pre_tokenize_str(text) else tokenizer


class WordEncoder:
    """Encodes texts unit by unit with a tokenizer that never joins across white space.

    A text's ids are its units' ids on end; a worker encodes each distinct unit
    once, and many at a time: runs of letters give one token sequence each, whose
    last token ends a word (``</w>``), so they are encoded as one text and cut
    apart at those ends. Words of small Latin-1 letters, which most
    are, skip the normalizer.
    """

    def __init__(self, definition: bytes):
        self.tokenizer = Tokenizer.from_str(definition.decode())
        self._plain = _plain(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.base = max(vocabulary.values()) + 1
        self._ends = np.zeros(self.base, bool)
        self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._cache = UnitCache(self._encode)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in made for i in ids], np.uint16), np.fromiter(map(len, made), np.int64, len(made))

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids on end and how many each word has."""
        letters = np.fromiter((w.isalpha() for w in words), bool, len(words))
        simple = letters & np.fromiter((w.islower() and max(w) < "\u0100" for w in words), bool, len(words))
        size = np.zeros(len(words), np.int64)
        parts = []
        for chosen, joined in ((simple, self._plain), (letters & ~simple, self.tokenizer), (~letters, None)):
            chosen = np.flatnonzero(chosen)
            for i in range(0, len(chosen), 1024):
                at = chosen[i : i + 1024]
                some = [words[j] for j in at.tolist()]
                if joined:
                    text = joined.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0]
                    ids = np.array(text.ids, np.uint16)
                    each = np.diff(np.flatnonzero(self._ends[ids]), prepend=-1)
                if not joined or len(each) != len(some):  # some letter is not one for the tokenizer
                    ids, each = self._each(some)
                size[at] = each
                parts.append((at, ids))
        out = np.empty(int(size.sum()), np.uint16)
        begin = np.cumsum(size) - size
        for at, ids in parts:
            n = size[at]
            out[np.repeat(begin[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, size

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts on end, each closed by ``end_id``, and ids per text."""
        data, offsets = utf8(texts)
        data, starts, ends, text = units(data, offsets)
        body, each = self._cache.ids(data, starts, ends)
        counts = np.bincount(text, weights=each, minlength=len(offsets) - 1).astype(np.int64) + 1
        out = np.full(len(body) + len(counts), end_id, np.uint16)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(counts) - 1] = False
        out[inside] = body
        return out, counts


def encoder(definition: bytes) -> WordEncoder:
    key = hash(definition)
    if key not in _encoders:
        _encoders[key] = WordEncoder(definition)
    return _encoders[key]


def _repeated(seq: np.ndarray, maybe: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that occur ``least`` times or more at the places ``maybe``, their places, and the pair of each place."""
    n = np.count_nonzero(maybe)
    if 2 * n > len(seq) > HASHED:  # most places: hash buckets by slices of the whole sequence
        bits = 16 if least >= 64 else 18 if least > 2 else 20
        bucket = (seq[:-1] * np.uint32(0x9E3779B1) + seq[1:] * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)
        bucket = bucket.astype(np.intp)  # once, for both uses
        frequent = np.bincount(bucket, minlength=1 << bits) >= least
        at = np.flatnonzero(frequent[bucket] & maybe[:-1])
        a, b = seq[at], seq[at + 1]
    else:
        at = np.flatnonzero(maybe)
        a, b = seq[at], seq[at + 1]
        if n > HASHED:
            bucket = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(12)
            bucket = bucket.astype(np.intp)
            use = (np.bincount(bucket, minlength=1 << 20) >= least)[bucket]
            at, a, b = at[use], a[use], b[use]
    keys = a.astype(np.uint64) << np.uint64(32) | b
    order = np.argsort(keys)
    ordered = keys[order]
    begin = np.ones(len(keys), bool)
    begin[1:] = ordered[1:] != ordered[:-1]
    start = np.flatnonzero(begin)
    number = np.diff(np.append(start, len(keys)))
    often = number >= least
    kept = np.repeat(often, number)
    which = np.full(len(keys), -1, np.int64)
    which[order[kept]] = np.repeat(np.arange(np.count_nonzero(often)), number[often])
    use = which >= 0
    return ordered[start[often]], at[use], which[use]


def compress(ids: np.ndarray, counts: np.ndarray, base: int) -> dict[str, np.ndarray]:
    """Re-Pair of a block: rules, their lengths, the symbols left, each document's first symbol.

    A round replaces all pairs that occur ``least`` times or more, without
    overlap of their own; where two of them overlap the more frequent pair wins,
    then the left one, and a pair that is left with one occurrence stays. ``least``
    is quartered from round to round down to two, and rounds go on until no pair
    occurs twice. From then on only places that repeated before, or beside a new
    symbol, can hold a repeated pair, so the last rounds are short.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(counts) - 1] = True
    maybe = ~last  # places whose pair may be repeated
    lefts, rights = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    length = [np.ones(base, np.int64)]
    symbol, least = base, max(2, len(seq) >> 10)
    while True:
        pairs, at, which = _repeated(seq, maybe, least)
        if least == 2:
            maybe = np.zeros(len(seq), bool)
            maybe[at] = True
        # in a run of one id every second pair is used
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) > 1) | (which[1:] != which[:-1])
        number = np.arange(len(at))
        even = (number - np.maximum.accumulate(np.where(fresh, number, 0))) % 2 == 0
        at, which = at[even], which[even]
        number = np.bincount(which, minlength=len(pairs))
        order = np.argsort(-number, kind="stable")
        order = order[: np.count_nonzero(number >= least)]
        rank = np.full(len(pairs), len(pairs), np.int64)
        rank[order] = np.arange(len(order))
        mine = rank[which]
        use = mine < len(order)
        at, mine = at[use], mine[use]
        taken = []
        for _ in range(2):
            touch = np.diff(at) == 1
            win = np.ones(len(at), bool)
            win[1:] &= ~touch | (mine[1:] < mine[:-1])
            win[:-1] &= ~touch | (mine[:-1] <= mine[1:])
            taken.append((at[win], mine[win]))
            blocked = np.zeros(len(seq) + 1, bool)
            blocked[at[win]] = blocked[at[win] + 1] = blocked[at[win] - 1] = True
            rest = ~blocked[at]
            at, mine = at[rest], mine[rest]
        where, mine = (np.concatenate(c) for c in zip(*taken))
        twice = np.bincount(mine, minlength=len(order)) > 1
        use = twice[mine]
        where, made = where[use], (np.cumsum(twice) - 1)[mine[use]]
        if not len(where):
            if least == 2:  # the most frequent pair always wins, so none occurs twice
                break
            least = max(2, least // 4)
            continue
        chosen = pairs[order[twice]]
        left, right = (chosen >> np.uint64(32)).astype(np.uint32), (chosen & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        known = np.concatenate(length)
        lefts.append(left)
        rights.append(right)
        length = [known, known[left] + known[right]]
        seq[where] = (symbol + made).astype(np.uint32)
        last[where] |= last[where + 1]
        maybe[where] = True
        maybe[np.maximum(where - 1, 0)] = True
        maybe &= ~last
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq, last, maybe = seq[keep], last[keep], maybe[keep]
        symbol += len(chosen)
        least = max(2, least // 4)
    first = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1)) if len(counts) else np.zeros(0, np.int64)
    return {
        "first_symbol": first,
        "left": np.concatenate(lefts),
        "right": np.concatenate(rights),
        "length": np.concatenate(length)[base:].astype(np.int32),
        "symbols": seq,
    }


def pack(numbers: np.ndarray, largest: int) -> bytes:
    """Low 16 bits of every number, then the planes of the higher bits that ``largest`` has."""
    planes = [np.packbits((numbers >> np.uint32(i)).astype(np.uint8) & 1) for i in range(16, largest.bit_length())]
    return b"".join([numbers.astype("<u2").tobytes(), *(p.tobytes() for p in planes)])


def unpack(data: bytes, count: int, largest: int) -> np.ndarray:
    numbers = np.frombuffer(data, "<u2", count).astype(np.uint32)
    width = (count + 7) // 8
    for i in range(16, largest.bit_length()):
        plane = np.frombuffer(data, np.uint8, width, 2 * count + (i - 16) * width)
        numbers |= np.unpackbits(plane, count=count).astype(np.uint32) << np.uint32(i)
    return numbers


class Grammar:
    """Decodes symbols of a block: every rule's expansion lies in one flat table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, length: np.ndarray, base: int):
        self.length = np.concatenate((np.ones(base, np.int64), length))
        self.start = np.concatenate((np.arange(base), base + np.concatenate(([0], np.cumsum(length, dtype=np.int64)))[:-1]))
        self.table = np.empty(base + int(length.sum(dtype=np.int64)), np.uint16)
        self.table[:base] = np.arange(base)
        needs = np.maximum(left, right)
        a = 0
        while a < len(left):  # rules whose parts are known: about a round of the compression at a time
            open_ = needs[a:] >= base + a
            b = a + int(np.argmax(open_)) if open_.any() else len(left)
            body = self.expand(np.stack((left[a:b], right[a:b]), axis=1).ravel())
            at = self.start[base + a]
            self.table[at : at + len(body)] = body
            a = b

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        each = self.length[symbols]
        before = np.cumsum(each) - each
        return self.table[np.repeat(self.start[symbols] - before, each) + np.arange(each.sum())]


def _grammar(get: dict[str, pa.Scalar]) -> tuple[Grammar, np.ndarray]:
    """The rules and the symbols of a row of the file."""
    base = get["base"].as_py()
    length = np.frombuffer(get["length"].as_py(), "<i4")
    largest = base + len(length) - 1
    left, right = (unpack(get[n].as_py(), len(length), largest) for n in ("left", "right"))
    return Grammar(left, right, length, base), unpack(get["symbols"].as_py(), get["n_symbols"].as_py(), largest)


FILE_SCHEMA = (
    "part int, block int, base int, total long, doc_id array<long>, first_symbol array<int>, n_ids array<int>, "
    "left binary, right binary, length binary, n_symbols int, symbols binary"
)


def write_ids(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, path: str | None = None
) -> str:
    """Encode every text, close it with ``end_id``, and write the blocks in ascending doc_id order.

    ``tokenizer`` is the path of a tokenizers file of at most 65,536 ids (default:
    the public word-BPE vocabulary); its content travels to the workers. Returns
    the folder (default: fresh, in the shared scratch).

    Defined cases: null and empty texts are the end id alone; rows without an id
    come first; rows of equal id are ordered by a hash of their text; a very long
    text makes a block of its own; an empty table gives a folder without rows;
    other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    on_workers(spark)
    with open(tokenizer or public_tokenizers.path(TOKENIZER), "rb") as f:
        definition = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        words = encoder(definition)
        ids, ids_each, names, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, held
            flat, counts = np.concatenate(ids), np.concatenate(ids_each)
            made = compress(flat, counts, words.base)
            largest = words.base + len(made["left"]) - 1
            row = {
                "part": part, "block": number, "base": words.base, "total": len(flat),
                "doc_id": pa.concat_arrays(names).to_pylist(),
                "first_symbol": made["first_symbol"].tolist(), "n_ids": counts.tolist(),
                "left": pack(made["left"], largest), "right": pack(made["right"], largest),
                "length": made["length"].astype("<i4").tobytes(),
                "n_symbols": len(made["symbols"]), "symbols": pack(made["symbols"], largest),
            }
            number, held = number + 1, 0
            ids.clear(), ids_each.clear(), names.clear()
            types = [
                pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()),
                pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(),
            ]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], names=list(row))

        for batch in batches:
            for a, b in slices(batch.column(1)):
                some = batch.slice(a, b - a)
                flat, counts = words.encode(some.column(1), end_id)
                ids.append(flat)
                ids_each.append(counts)
                names.append(some.column(0))
                held += len(flat)
                if held >= BLOCK_IDS:
                    yield block()
        if held:
            yield block()

    path = path or f"{scratch_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    rows = pick(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    ordered.select("doc_id", "text").mapInArrow(run, FILE_SCHEMA).write.parquet(path)
    return path


def _starts(blocks: DataFrame) -> DataFrame:
    """(part, block, before): ids before each block, by sums per part first."""
    slim = blocks.select("part", "block", "total")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("total").over(earlier.partitionBy("part").orderBy("block")), F.lit(0))
    parts = slim.groupBy("part").agg(F.sum("total").alias("n"))  # one row per task that wrote
    across = F.coalesce(F.sum("n").over(earlier.orderBy("part")), F.lit(0))
    parts = parts.select("part", across.alias("across"))
    return slim.withColumn("within", within).join(parts, "part").select(
        "part", "block", (F.col("across") + F.col("within")).alias("before")
    )


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ``ids``) of every document in a written folder.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is the
    unsigned CRC-32 of the document's ids as little-endian unsigned 32-bit
    integers, taken over the decoded ids.
    """
    on_workers(spark)
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    schema = "part int, block int, doc_id long, offset long, n_tokens long, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = {n: batch.column(n)[row] for n in batch.schema.names}
                grammar, symbols = _grammar(get)
                first = get["first_symbol"].values.to_numpy()
                flat = grammar.expand(symbols)
                # ids of each document: what its own symbols expand to
                ends = np.append(first[1:], len(symbols))
                reach = np.concatenate(([0], np.cumsum(grammar.length[symbols])))
                offset, stop = reach[first], reach[ends]
                wide = flat.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(offset.tolist(), stop.tolist())]
                n = len(first)
                columns = [
                    pa.array(np.full(n, get["part"].as_py(), np.int32)),
                    pa.array(np.full(n, get["block"].as_py(), np.int32)),
                    get["doc_id"].values,
                    pa.array(offset.astype(np.int64)),
                    pa.array((stop - offset).astype(np.int64)),
                    pa.array(crc, pa.int64()),
                ]
                if with_ids:
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.append(offset, len(flat)).astype(np.int32)), pa.array(flat.astype(np.int32))
                    )
                    columns.append(lists)
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    documents = blocks.mapInArrow(run, schema)
    out = documents.join(_starts(blocks), ["part", "block"]).withColumn("start", F.col("before") + F.col("offset"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


#: Most documents of one :func:`read_documents` call; their ids travel to the workers.
MOST_ASKED = 10_000


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, n_tokens, ids of the asked documents of a written folder, in no order.

    The blocks that hold one are found in their doc_id columns; only those
    blocks are read, and in them only the symbols of the asked documents are
    expanded. An id that stands several times gives all its rows, one that is
    not there none. At most ``MOST_ASKED`` ids (ValueError).
    """
    asked = sorted({int(i) for i in doc_ids})
    if len(asked) > MOST_ASKED:
        raise ValueError(f"at most {MOST_ASKED} documents")
    on_workers(spark)
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    schema = "doc_id long, n_tokens long, ids array<int>"
    if not asked:
        return spark.createDataFrame([], schema)
    wanted = F.array(*[F.lit(i).cast("long") for i in asked])
    places = blocks.select("part", "block", "doc_id").where(F.arrays_overlap("doc_id", wanted)).select("part", "block").collect()
    if not places:
        return spark.createDataFrame([], schema)
    here = F.struct("part", "block").isin([F.struct(F.lit(r["part"]), F.lit(r["block"])) for r in places])
    chosen = blocks.where(F.col("part").isin(sorted({r["part"] for r in places})) & here)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = {n: batch.column(n)[row] for n in batch.schema.names}
                grammar, symbols = _grammar(get)
                first = get["first_symbol"].values.to_numpy()
                ends = np.append(first[1:], len(symbols))
                names = get["doc_id"].values
                for at in np.flatnonzero(pc.is_in(names, pa.array(asked, pa.int64())).to_numpy(zero_copy_only=False)):
                    ids = grammar.expand(symbols[first[at] : ends[at]]).astype(np.int32)
                    columns = [names.slice(at, 1), pa.array([len(ids)], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids"])

    return chosen.mapInArrow(run, schema)
