"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows of ``WINDOW`` bytes; in each, one recurrent network runs
forwards and one backwards, both states together label every byte with a
probability per language, and a document's probabilities are the mean over all
of its bytes. The network is trained in numpy by backpropagation through time on
a bounded, balanced sample of labelled documents, with every position's label as
target; it is a few thousand numbers and travels with the tasks that apply it to
the whole table.

Gates, with x the row of the byte and h the state: z = sigmoid(x_z + h U_z),
r = sigmoid(x_r + h U_r), c = squash(x_c + r * (h U_c)), h' = c + z * (h - c).
squash(a) is a / (1 + |a|) and sigmoid(a) is (1 + squash(a)) / 2: the usual curves
without exponentials, which would take most of the time. Arrays hold the
direction first and the windows last, so that every step works on long rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import add_columns, on_workers, pick, unclash
from ledgerline.llm.textvec import utf8

WINDOW = 64
HIDDEN = 6
#: Bounds of the training sample: languages, documents of one language, documents, windows of one document.
MOST_LANGUAGES = 64
ROWS_PER_LANGUAGE = 1500
SAMPLE_ROWS = 20_000
WINDOWS_PER_ROW = 6
STEPS = 400
BATCH = 256

UNKNOWN = "und"
_BLOCK = 1024  # windows that one vectorised step works on


@dataclass
class Network:
    """``rows`` (2, 3H, 256): a byte's share of the gates; ``state`` (2, 3H, H); ``out`` (2H, K); ``bias`` (K)."""

    rows: np.ndarray
    state: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.rows, self.state, self.out, self.bias]


def new_network(languages: int, hidden: int = HIDDEN, seed: int = 11, dtype=np.float32) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(dtype)
    return Network(
        draw(2, 3 * hidden, 256, scale=0.3),
        draw(2, 3 * hidden, hidden, scale=hidden**-0.5),
        draw(2 * hidden, languages, scale=0.3),
        np.zeros(languages, dtype),
    )


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    size = np.abs(x)
    size += 1
    x /= size
    return x


def _orders(data: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(2, L, B): bytes in the order each direction reads them; (L, B): the backward step of each position.

    Windows are ``data`` (L, B), of which the first ``length`` positions count;
    both directions read those first, so that padding never reaches them. None
    instead of the steps where all windows are full: then it is the reverse order.
    """
    size = len(data)
    if (length == size).all():
        return np.stack([data, data[::-1]]), None
    back = np.maximum(length - 1 - np.arange(size)[:, None], 0)
    return np.stack([data, np.take_along_axis(data, back, 0)]), back


def _states(net: Network, orders: np.ndarray, keep: list | None = None) -> np.ndarray:
    """(2, H, L, B): the state after each step; ``keep`` collects what backpropagation needs."""
    _, size, width = orders.shape
    h3 = net.rows.shape[1]
    n = h3 // 3
    h = np.zeros((2, n, width), net.rows.dtype)
    made = np.empty((2, n, size, width), net.rows.dtype)
    x = np.empty((2, h3, width), net.rows.dtype)
    for t in range(size):
        for d in (0, 1):
            np.take(net.rows[d], orders[d, t], axis=1, out=x[d], mode="clip")
        g = np.matmul(net.state, h)
        gates = x[:, : 2 * n] + g[:, : 2 * n]
        _squash(gates)
        gates += 1
        gates *= 0.5
        z, r = gates[:, :n], gates[:, n:]
        c = r * g[:, 2 * n :]
        c += x[:, 2 * n :]
        _squash(c)
        if keep is not None:
            keep.append((h, z, r, c, g[:, 2 * n :]))
        h = h - c
        h *= z
        h += c
        made[:, :, t] = h
    return made


def _aligned(values: np.ndarray, back: np.ndarray | None) -> np.ndarray:
    """(N, L, B) values of the backward steps, put at the positions that they read."""
    if back is None:
        return values[:, ::-1]
    return np.take_along_axis(values, np.broadcast_to(back, values.shape), 1)


def _probabilities(net: Network, states: np.ndarray, back: np.ndarray | None) -> np.ndarray:
    """(K, L, B): each position's probability per language."""
    _, n, size, width = states.shape
    forward, backward = (net.out[d * n : (d + 1) * n].T @ states[d].reshape(n, -1) for d in (0, 1))
    p = forward.reshape(-1, size, width)
    p += _aligned(backward.reshape(-1, size, width), back)
    p += net.bias[:, None, None]
    p -= p.max(0)
    np.exp(p, out=p)
    p /= p.sum(0)
    return p


def label_positions(net: Network, data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(K, L, B) probabilities of every position of the windows ``data`` (L, B)."""
    orders, back = _orders(data, length)
    return _probabilities(net, _states(net, orders), back)


def loss_and_gradient(net: Network, data: np.ndarray, length: np.ndarray, target: np.ndarray) -> tuple[float, Network]:
    """Mean cross-entropy over all positions and its gradient, by backpropagation through time."""
    size, width = data.shape
    n = net.state.shape[2]
    orders, back = _orders(data, length)
    kept: list = []
    states = _states(net, orders, kept)
    p = _probabilities(net, states, back)
    inside = (np.arange(size)[:, None] < length) / length.sum()
    of = np.arange(width)
    loss = float(-(np.log(p[target, :, of].T + 1e-30) * inside).sum())

    error = p.copy()
    error[target, :, of] -= 1
    error *= inside.astype(p.dtype)
    # errors at positions become errors at steps: the backward order, and nothing past the end
    steps = [error, _aligned(error, back)]
    if back is not None:
        steps[1] = steps[1] * (inside > 0)
    flat = [e.reshape(len(e), -1) for e in steps]
    out = np.concatenate([states[d].reshape(n, -1) @ flat[d].T for d in (0, 1)])
    reach = np.stack([(net.out[d * n : (d + 1) * n] @ flat[d]).reshape(n, size, width) for d in (0, 1)])

    state = np.zeros_like(net.state)
    dh = np.zeros((2, n, width), p.dtype)
    d3 = np.empty((2, 3 * n, width), p.dtype)
    pushed = np.empty((2, 3 * n, size, width), p.dtype)
    for t in range(size - 1, -1, -1):
        h, z, r, c, gc = kept[t]
        dh += reach[:, :, t]
        da = dh * (1 - z) * (1 - np.abs(c)) ** 2
        d3[:, :n] = dh * (h - c) * (1 - np.abs(2 * z - 1)) ** 2 / 2
        d3[:, n : 2 * n] = da * gc * (1 - np.abs(2 * r - 1)) ** 2 / 2
        pushed[:, : 2 * n, t] = d3[:, : 2 * n]
        pushed[:, 2 * n :, t] = da
        d3[:, 2 * n :] = da * r
        state += np.matmul(d3, h.transpose(0, 2, 1))
        dh = dh * z + np.matmul(net.state.transpose(0, 2, 1), d3)
    rows = np.zeros_like(net.rows)
    for d in (0, 1):
        read = orders[d].ravel()
        order = np.argsort(read, kind="stable")
        found, first = np.unique(read[order], return_index=True)
        rows[d][:, found] = np.add.reduceat(pushed[d].reshape(3 * n, -1)[:, order], first, axis=1)
    return loss, Network(rows, state, out, error.sum((1, 2)))


def train(windows: list[np.ndarray], target: np.ndarray, languages: int, steps: int = STEPS, hidden: int = HIDDEN, seed: int = 11) -> Network:
    """A network fitted by Adam to byte windows (at most ``WINDOW`` bytes each) and their languages.

    Every step draws the languages alike often, so a rare one is learned too.
    """
    net = new_network(languages, hidden, seed)
    rng = np.random.default_rng(seed)
    length = np.array([len(w) for w in windows])
    data = np.zeros((len(windows), WINDOW), np.uint8)
    for i, w in enumerate(windows):
        data[i, : len(w)] = w
    of = [np.flatnonzero(target == k) for k in range(languages)]
    first = [np.zeros_like(a) for a in net.arrays()]
    second = [np.zeros_like(a) for a in net.arrays()]
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(of[k], -(-BATCH // languages)) for k in range(languages)])
        _, slope = loss_and_gradient(net, data[chosen].T, length[chosen], target[chosen])
        norm = np.sqrt(sum(float((g * g).sum()) for g in slope.arrays()))
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for a, g, m, v in zip(net.arrays(), slope.arrays(), first, second):
            g = g * min(1.0, 1.0 / max(norm, 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(a.dtype)
    return net


def _windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, skip, text) of the windows that cover every byte of every text.

    The last window of a text reaches back over ``skip`` positions that the one
    before has labelled; a text shorter than a window is one short window.
    """
    n = np.diff(offsets)
    count = -(-n // WINDOW)
    text = np.repeat(np.arange(len(n)), count)
    rank = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(rank * WINDOW, np.maximum(n[text] - WINDOW, 0))
    return offsets[text] + start, np.minimum(n[text], WINDOW), rank * WINDOW - start, text


def document_probabilities(net: Network, texts: pa.Array) -> np.ndarray:
    """(texts, K): mean probabilities over all bytes of each text; zeros where it has none."""
    data, offsets = utf8(texts)
    start, length, skip, text = _windows(offsets)
    total = np.zeros((len(texts), len(net.bias)))
    step = np.arange(WINDOW)[:, None]
    for a in range(0, len(start), _BLOCK):
        s, n, over = start[a : a + _BLOCK], length[a : a + _BLOCK], skip[a : a + _BLOCK]
        whole = np.take(data, s + step, mode="clip")  # beyond a short window: never counted
        p = label_positions(net, whole, n)
        if over.any() or (n < WINDOW).any():
            p *= ((step >= over) & (step < n)).astype(p.dtype)
        np.add.at(total, text[a : a + _BLOCK], p.sum(1, dtype=np.float64).T)
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def _held_out() -> Column:
    """crc32(doc_id as text) mod 5 is 0; a row without id is held out too."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return F.coalesce(crc % 5 == 0, F.lit(True))


def _excerpts(text: str) -> bytes:
    """Up to ``WINDOWS_PER_ROW`` windows at even distances over the whole text."""
    raw = text.encode()
    if len(raw) <= WINDOW:
        return raw
    places = np.linspace(0, len(raw) - WINDOW, min(WINDOWS_PER_ROW, -(-len(raw) // WINDOW))).astype(int)
    return b"".join(raw[i : i + WINDOW] for i in places)


def training_sample(docs: DataFrame) -> list[tuple[str, bytes]]:
    """(lang, excerpts) of a bounded sample of the labelled documents that are not held out.

    Rows with the smallest seeded hashes of their text are taken, different
    texts only, at about the same number per language: at most ``SAMPLE_ROWS``
    rows of the ``MOST_LANGUAGES`` most frequent languages.
    """
    on_workers(docs.sparkSession)
    text_hash = F.xxhash64(F.lit(11), "text")
    letters = F.col("text").rlike(r"\p{L}")
    known = pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~_held_out() & letters)
    known = known.select("lang", "text", text_hash.alias("h"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    rates = [(r["lang"], min(1.0, 1.2 * ROWS_PER_LANGUAGE / max(r["n"], 1))) for r in sizes.collect()]
    if not rates:
        return []
    rate = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in rates for x in pair]), F.col("lang")), F.lit(0.0))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = pa.array([_excerpts(t) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cut], names=["lang", "h", "cut"])

    chosen = known.where(F.pmod("h", F.lit(1 << 20)) < rate * (1 << 20)).select("lang", "h", "text")
    cuts = chosen.mapInArrow(run, "lang string, h long, cut binary").groupBy("lang", "h").agg(F.min("cut").alias("cut"))
    rows = cuts.orderBy("h", "lang").limit(SAMPLE_ROWS).collect()
    return sorted((r["lang"], bytes(r["cut"])) for r in rows)


@dataclass
class Identifier:
    """A trained network and the languages that it tells apart."""

    languages: list[str]
    net: Network | None

    def predict(self, texts: pa.Array) -> dict[str, pa.Array]:
        """lang_pred and score of each text; a null text is unknown."""
        if self.net is None:
            return {"lang_pred": pa.array([UNKNOWN] * len(texts)), "score": pa.array(np.zeros(len(texts)))}
        p = document_probabilities(self.net, texts)
        best, score = p.argmax(1), np.minimum(p.max(1), 1.0)
        known = score > 0
        names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)]
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score)}


def learn(docs: DataFrame, steps: int = STEPS) -> Identifier:
    """An identifier learned from the labelled documents that are not held out."""
    sample = training_sample(docs)
    languages = sorted({lang for lang, _ in sample})
    if len(languages) < 2:
        return Identifier(languages, new_network(1) if languages else None)
    windows, target = [], []
    for lang, cut in sample:
        raw = np.frombuffer(cut, np.uint8)
        for a in range(0, len(raw), WINDOW):
            windows.append(raw[a : a + WINDOW])
            target.append(languages.index(lang))
    return Identifier(languages, train(windows, np.array(target), len(languages), steps))


def identify(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """``docs`` with lang_pred and score (the mean probability of that language).

    Defined cases: a null text or one without letters is ``und`` with score 0;
    repeated rows get equal predictions; without labelled rows to learn from
    every text is ``und``; with one language every text has it; an empty table
    gives an empty result; columns named like a new one are replaced. Texts of
    any length are read whole, window by window.
    """
    docs = unclash(docs, ("text",), ("lang_pred", "score", "ll_read"))
    read = docs.withColumn("ll_read", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")))
    schema = T.StructType().add("lang_pred", "string").add("score", "double")
    return add_columns(read, "ll_read", schema, identifier.predict).drop("ll_read")


def languages_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the same table."""
    identifier = learn(docs)
    found = identify(pick(docs, "doc_id", "text").withColumn("held_out", _held_out()), identifier)
    return found.select("doc_id", "held_out", "lang_pred", "score")
