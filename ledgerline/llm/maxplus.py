"""SentencePiece encoding by best segmentation, and decoding.

A text is cut into vocabulary pieces with the highest sum of scores (the
unigram reading of a SentencePiece vocabulary), among equals with the longest
last piece, then the longest before it, and so on. Characters in no piece become
byte pieces. Scores are integers, so sums are exact at any length.

Ordinary texts are solved word by word in one task; no piece spans the start of
a run of white space. A giant text is cut into chunks anywhere and solved by
all tasks together: the state at a chunk's border is how far the piece across it
reaches into the next chunk. Each chunk gives a max-plus transfer matrix between
the states at its two borders; matrices combine associatively, and their prefix
products give every chunk its entry scores. With those a chunk traces its best
pieces back on its own, for each state it may be left in; which of these holds
is settled border by border from the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_format

from ledgerline.llm.common import SLICE_BYTES, add_columns, on_workers, slices, unclash
from ledgerline.llm.textvec import utf8
from ledgerline.llm.unit_cache import UnitCache
from ledgerline.plans.materialize import stage

VOCABULARY = "piece_bpe_32k.model"
SPACE_MARK = "▁"
#: Texts of more characters are encoded chunk by chunk.
GIANT_CHARS = 1 << 16
CHUNK_CHARS = 1 << 12
#: Distinct words whose pieces a worker remembers.
CACHE_UNITS = 1 << 19
#: Chunks that one vectorised step works on.
BATCH_CHUNKS = 16
UNK_PENALTY = 10
#: Fractional scores become whole multiples of one part in so many: exact for single-precision scores of 1 or more.
FIXED_POINT = 1 << 24
NEVER = -(1 << 60)

_encoders: dict[int, PieceEncoder] = {}  # by hash of the vocabulary; lives as long as the worker


class PieceEncoder:
    """Best segmentation into the pieces of a SentencePiece model, and back."""

    def __init__(self, definition: bytes):
        model = model_format.ModelProto()
        model.ParseFromString(definition)
        unit = 1 if all(p.score.is_integer() for p in model.pieces if p.type == 1) else FIXED_POINT
        self.pieces = {p.piece: (i, round(p.score * unit)) for i, p in enumerate(model.pieces) if p.type == 1}
        self.longest = max(map(len, self.pieces))
        self.unk = min(s for _, s in self.pieces.values()) - UNK_PENALTY * unit
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.splits_lines = not any("\n" in p for p in self.pieces)
        # every beginning of a piece, with the piece's score and id if it is one
        self._grow: dict[str, tuple[int, int] | None] = {p[:j]: None for p in self.pieces for j in range(1, len(p))}
        self._grow.update({p: (s, i) for p, (i, s) in self.pieces.items()})
        self._spoken = [b""] * len(model.pieces)
        for p, (i, _) in self.pieces.items():
            self._spoken[i] = p.replace(SPACE_MARK, " ").encode()
        for b, i in self.byte.items():
            self._spoken[i] = bytes([b])
        self._spoken_size = np.array([len(s) for s in self._spoken])
        self._spoken_start = np.cumsum(self._spoken_size) - self._spoken_size
        self._spoken_data = np.frombuffer(b"".join(self._spoken), np.uint8)
        self._cache = UnitCache(self._words, CACHE_UNITS)
        keys = np.array([_code_hash(p) for p in self.pieces], np.uint64)
        order = np.argsort(keys)
        self._keys = keys[order]
        self._scores = np.array([s for _, s in self.pieces.values()], np.int64)[order]
        self._ids = np.array([i for i, _ in self.pieces.values()], np.int32)[order]
        self._maybe = np.zeros(1 << 20, bool)
        self._maybe[(keys >> np.uint64(44)).astype(np.int64)] = True

    def best(self, text: str) -> list[int]:
        """The best segmentation of a normalised text, by plain dynamic programming."""
        n, grow = len(text), self._grow
        score, back, piece = [0] + [NEVER] * n, [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            here = score[i]
            if text[i] not in self.pieces and here + self.unk > score[i + 1]:
                score[i + 1], back[i + 1], piece[i + 1] = here + self.unk, i, -1
            for j in range(i + 1, n + 1):
                found = grow.get(text[i:j], 0)
                if found is None:
                    continue
                if not found:
                    break
                if here + found[0] > score[j]:
                    score[j], back[j], piece[j] = here + found[0], i, found[1]
        out, j = [], n
        while j:
            i = back[j]
            if piece[j] >= 0:
                out.append(piece[j])
            else:
                out += [self.byte[b] for b in reversed(text[i].encode())]
            j = i
        return out[::-1]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [self.best(w.replace(" ", SPACE_MARK)) for w in words]
        return np.array([i for ids in made for i in ids], np.uint16), np.fromiter(map(len, made), np.int64, len(made))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end and how many each has (null: as empty)."""
        data, offsets = utf8(normalised(texts))
        n = len(data)
        if not n:
            return np.zeros(0, np.uint16), np.zeros(len(offsets) - 1, np.int64)
        space = data == 32
        head = np.zeros(n + 1, bool)
        head[offsets] = True
        head = head[:n]
        head[1:] |= space[1:] & ~space[:-1]
        if self.splits_lines:
            line = data == 10
            head[1:] |= line[:-1] | line[1:]
        starts = np.flatnonzero(head)
        flat, each = self._cache.ids(data, starts, np.append(starts[1:], n))
        text = np.searchsorted(offsets, starts, "right") - 1
        return flat, np.bincount(text, weights=each, minlength=len(offsets) - 1).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of ids on end: the inverse of ``encode`` up to the white-space mark."""
        size = self._spoken_size[ids]
        at = np.repeat(self._spoken_start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        data = self._spoken_data[at]
        ends = np.concatenate(([0], np.cumsum(size)))[np.cumsum(counts)]
        begins = np.concatenate(([0], ends[:-1]))
        keep = np.ones(len(data), bool)
        keep[begins[counts > 0]] = False  # the space put before every text
        lengths = ends - begins - (counts > 0)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[keep].tobytes())]
        return pa.Array.from_buffers(pa.large_string(), len(counts), buffers).cast(pa.string())

    # chunks of giant texts

    def lattice(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the piece of each length at each place: (chunks, places, longest)."""
        chunks, places = codes.shape
        mixed = _code(codes)
        score = np.full((chunks, places, self.longest), NEVER, np.int64)
        piece = np.full((chunks, places, self.longest), -1, np.int32)
        h = np.zeros((chunks, places), np.uint64)
        alive = codes > 0  # zero pads the end of a text
        for k in range(self.longest):
            width = places - k
            h[:, :width] += mixed[:, k:] * _POWERS[k]
            alive[:, :width] &= codes[:, k:] > 0
            alive[:, width:] = False
            key = _finish(h, k + 1)
            row, at = np.nonzero(alive & self._maybe[(key >> np.uint64(44)).astype(np.int64)])
            found = key[row, at]
            i = np.minimum(np.searchsorted(self._keys, found), len(self._keys) - 1)
            hit = self._keys[i] == found
            score[row[hit], at[hit], k], piece[row[hit], at[hit], k] = self._scores[i[hit]], self._ids[i[hit]]
        unknown = (codes > 0) & (piece[:, :, 0] < 0)
        score[:, :, 0][unknown] = self.unk
        return score, piece

    def transfer(self, score: np.ndarray, chars: int) -> np.ndarray:
        """Max-plus matrices (chunks, entry state, exit state) of chunks of ``chars`` places."""
        chunks, _, k = score.shape
        value = np.full((chunks, chars + k, k), NEVER, np.int64)  # by place and entry state
        value[:, np.arange(k), np.arange(k)] = 0
        for p in range(chars):
            if p < k:  # an entry state is the first border in the chunk: it starts there
                value[:, p, p + 1 :] = NEVER
            reach = value[:, p, None, :] + score[:, p, :, None]
            np.maximum(value[:, p + 1 : p + 1 + k], reach, out=value[:, p + 1 : p + 1 + k])
        return np.maximum(value[:, chars : chars + k].swapaxes(1, 2), NEVER)

    def trace(self, score: np.ndarray, piece: np.ndarray, codes: np.ndarray, entry: np.ndarray, chars: int):
        """(chunk, exit state, entry state, ids) of the best way through each chunk to each exit state."""
        chunks, _, k = score.shape
        value = np.full((chunks, chars + k), NEVER, np.int64)
        value[:, :k] = entry
        back = np.zeros((chunks, chars + k), np.int8)  # length of the piece that ends here; 0: entered here
        for p in range(chars):
            reach = value[:, p, None] + score[:, p]
            part = value[:, p + 1 : p + 1 + k]
            better = reach > part
            part[better] = reach[better]
            back[:, p + 1 : p + 1 + k][better] = np.broadcast_to(np.arange(1, k + 1, dtype=np.int8), better.shape)[better]
        for c in range(chunks):
            lengths, pieces = back[c].tolist(), piece[c]
            for t in range(k):
                if value[c, chars + t] <= NEVER // 2 or (t and not lengths[chars + t]):
                    continue
                out, j = [], chars + t
                while lengths[j]:
                    i = j - lengths[j]
                    found = int(pieces[i, lengths[j] - 1])
                    if found >= 0:
                        out.append(found)
                    else:
                        out += [self.byte[b] for b in reversed(chr(int(codes[c, i]) - 1).encode())]
                    j = i
                yield c, t, j, out[::-1]


_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)], np.uint64)


def _code(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _finish(h: np.ndarray, length: int) -> np.ndarray:
    x = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(length)
    return x ^ (x >> np.uint64(31))


def _code_hash(piece: str) -> int:
    codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
    codes = codes.astype(np.int64) + 1  # as in chunks
    return int(_finish((_code(codes) * _POWERS[: len(codes)]).sum(keepdims=True, dtype=np.uint64), len(codes))[0])


def normalised(texts: pa.Array) -> pa.Array:
    """Texts as the vocabulary sees them: marks as spaces, one space before a text that is not empty."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE_MARK, " ")
    texts = texts.cast(pa.large_string())
    nothing, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    return pc.if_else(pc.equal(texts, nothing), texts, pc.binary_join_element_wise(nothing, texts, space))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices."""
    return np.maximum((a[:, :, :, None] + b[:, None, :, :]).max(axis=2), NEVER)


def prefix_products(matrices: np.ndarray) -> np.ndarray:
    """Inclusive prefix products of a stack, in logarithmically many combining steps."""
    out, step = matrices.copy(), 1
    while step < len(out):
        out[step:] = product(out[:-step], out[step:])
        step *= 2
    return out


def encoder(definition: bytes) -> PieceEncoder:
    key = hash(definition)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(definition)
    return _encoders[key]


def vocabulary(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return f.read()


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))


CHUNK = "uid long, chunk int, codes binary"


def _chunks(chars: int, longest: int):
    """(uid, text) -> chunks of the normalised text, each with ``longest`` characters of the next.

    Characters are code points plus one; zeros pad the text's end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = normalised(batch.column(1).slice(i, 1))[0].as_py().replace(" ", SPACE_MARK)
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                n = -(-len(codes) // chars)
                padded = np.zeros(n * chars + longest, np.uint32)
                padded[: len(codes)] = codes + 1  # zero pads the end
                for c in range(0, n, BATCH_CHUNKS):
                    some = range(c, min(n, c + BATCH_CHUNKS))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch.column(0)[i].as_py()] * len(some), pa.int64()),
                            pa.array(some, pa.int32()),
                            pa.array([padded[j * chars : (j + 1) * chars + longest].tobytes() for j in some], pa.binary()),
                        ],
                        names=["uid", "chunk", "codes"],
                    )

    return run


def _codes(column: pa.Array, chars: int, longest: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, chars + longest)


def _matrix_rows(definition: bytes, chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(definition)
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH_CHUNKS):
                batch = whole.slice(i, BATCH_CHUNKS)
                score, _ = pieces.lattice(_codes(batch.column(2), chars, pieces.longest))
                made = pieces.transfer(score, chars)
                rows = pa.array([m.astype("<i8").tobytes() for m in made], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows], names=["uid", "chunk", "matrix"])

    return run


def _entries(longest: int):
    """The matrices of one text -> every chunk's entry scores."""

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("chunk").to_numpy())
        rows = rows.take(pa.array(order))
        flat = b"".join(rows.column("matrix").to_pylist())
        matrices = np.frombuffer(flat, "<i8").reshape(-1, longest, longest)
        # a text begins at its first border: entry state 0
        before = np.full((len(matrices), longest), NEVER, np.int64)
        before[0, 0] = 0
        before[1:] = prefix_products(matrices[:-1])[:, 0, :]
        top = before.max(axis=1, keepdims=True)
        before = np.where(before <= NEVER // 2, NEVER, before - top)
        return pa.table({
            "uid": rows.column("uid"), "chunk": rows.column("chunk"),
            "entry": pa.array([v.astype("<i8").tobytes() for v in before], pa.binary()),
        })

    return run


WAYS = "uid long, chunk int, leave int, enter int, ids array<int>"


def _ways(definition: bytes, chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(definition)
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH_CHUNKS):
                batch = whole.slice(i, BATCH_CHUNKS)
                codes = _codes(batch.column(2), chars, pieces.longest)
                # the last chunk's padding is crossed at no cost
                score, piece = pieces.lattice(codes)
                entry = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i8").reshape(-1, pieces.longest)
                rows = list(zip(*_last_ways(pieces, score, piece, codes, entry, chars)))
                if not rows:
                    continue
                c = pa.array(rows[0], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(c), batch.column(1).take(c), pa.array(rows[1], pa.int32()),
                        pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.list_(pa.int32())),
                    ],
                    names=["uid", "chunk", "leave", "enter", "ids"],
                )

    return run


def _last_ways(pieces, score, piece, codes, entry, chars):
    """Ways through chunks; a text's last chunk ends where its characters do, in exit state 0."""
    size = (codes[:, :chars] > 0).sum(axis=1)
    ends = (codes[:, chars] == 0) | (size < chars)
    middle = np.flatnonzero(~ends)
    if len(middle):
        for c, t, s, ids in pieces.trace(score[middle], piece[middle], codes[middle], entry[middle], chars):
            yield int(middle[c]), t, s, ids
    for c in np.flatnonzero(ends).tolist():
        for _, t, s, ids in pieces.trace(score[c : c + 1], piece[c : c + 1], codes[c : c + 1], entry[c : c + 1], int(size[c])):
            if t == 0:
                yield c, t, s, ids


def _chosen(rows: pa.Table) -> pa.Table:
    """The ways of one text -> the exit state of each chunk on the best path, settled from the end."""
    chunk, leave, enter = (rows.column(c).to_pylist() for c in ("chunk", "leave", "enter"))
    into = {(c, t): s for c, t, s in zip(chunk, leave, enter)}
    state, out = 0, []
    for c in range(max(chunk), -1, -1):
        out.append((c, state))
        state = into[(c, state)]
    uid = rows.column("uid")[0].as_py()
    return pa.table({
        "uid": pa.array([uid] * len(out), pa.int64()), "chunk": pa.array([c for c, _ in out], pa.int32()),
        "leave": pa.array([t for _, t in out], pa.int32()),
    })


def giant_ids(texts: DataFrame, definition: bytes, chars: int = CHUNK_CHARS) -> DataFrame:
    """(uid, ids) of the written (uid, text) rows, by the parallel scan over chunks."""
    longest = encoder(definition).longest
    if chars < longest:
        raise ValueError("a chunk must be longer than the longest piece")
    chunks = texts.mapInArrow(_chunks(chars, longest), CHUNK)
    chunks = stage(chunks.repartition(F.col("uid"), F.col("chunk")), "giant-chunks")
    matrices = chunks.mapInArrow(_matrix_rows(definition, chars), "uid long, chunk int, matrix binary")
    entries = matrices.groupBy("uid").applyInArrow(_entries(longest), "uid long, chunk int, entry binary")
    ready = chunks.join(entries, ["uid", "chunk"]).select("uid", "chunk", "codes", "entry")
    ways = stage(ready.mapInArrow(_ways(definition, chars), WAYS), "giant-ways")
    path = ways.select("uid", "chunk", "leave", "enter").groupBy("uid").applyInArrow(
        _chosen, "uid long, chunk int, leave int"
    )
    taken = ways.join(path, ["uid", "chunk", "leave"]).groupBy("uid")
    ordered = taken.agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    return ordered.select("uid", F.flatten("parts.ids").alias("ids"))


def encode(
    docs: DataFrame, path: str | None = None, giant_chars: int = GIANT_CHARS, chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """``docs`` with ``ids`` (array of int), the pieces of every text.

    ``path`` names a SentencePiece model (default: the public 32k vocabulary);
    its content travels to the workers.

    Defined cases: null and empty texts have no ids; a text is as long as it
    likes; repeated rows are all returned; an empty table gives an empty result;
    a column named ``ids`` is replaced, others pass through.
    """
    spark = docs.sparkSession
    on_workers(spark)
    definition = vocabulary(path)
    docs = unclash(docs, ("text",), ("ids", "uid", "ll_uid"))
    length = F.coalesce(F.length("text"), F.lit(0))
    usual = docs.where(length <= giant_chars)
    schema = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
    done = add_columns(usual, "text", schema, lambda t: {"ids": _lists(*encoder(definition).encode(t))})
    giant = stage(docs.where(length > giant_chars).withColumn("ll_uid", F.monotonically_increasing_id()), "giants")
    ids = giant_ids(giant.select(F.col("ll_uid").alias("uid"), "text"), definition, chunk_chars)
    solved = giant.join(ids, F.col("ll_uid") == F.col("uid")).select(*docs.columns, "ids")
    return done.unionByName(solved)


def decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` (with ``ids``) with ``decoded``, the text that the ids spell.

    It equals the encoded text, with the white-space mark itself read as a space;
    null ids give an empty text. A column named ``decoded`` is replaced.
    """
    on_workers(docs.sparkSession)
    definition = vocabulary(path)
    docs = unclash(docs, ("ids",), ("decoded",))
    names = docs.columns
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            for a, b in _runs(sizes, SLICE_BYTES // 4):
                part = batch.slice(a, b - a)
                ids = pc.list_flatten(part.column(at)).to_numpy(zero_copy_only=False)
                text = encoder(definition).decode(ids, sizes[a:b].astype(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=[*names, "decoded"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("decoded", T.StringType())]))


def digest(decoded: DataFrame) -> DataFrame:
    """``decoded`` with n_tokens and round_trip: whether the ids spell the text (marks read as spaces)."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(SPACE_MARK), F.lit(" "))
    decoded = unclash(decoded, ("text", "ids", "decoded"), ("n_tokens", "round_trip"))
    return decoded.withColumns(
        {"n_tokens": F.size("ids").cast("long"), "round_trip": text == F.coalesce("decoded", F.lit(""))}
    )


def _runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)
