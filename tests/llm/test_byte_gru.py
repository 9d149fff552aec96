"""The byte network: gradient, a plain recurrence, held-out accuracy, awkward rows."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import CLASHING, awkward, clashing, documents, empty

from conftest import SF_SMALL
from ledgerline.llm import byte_gru
from ledgerline.llm.byte_gru import UNKNOWN, WINDOW, Identifier, document_probabilities, label_positions, loss_and_gradient, new_network
from ledgerline.llm.queries import QUERIES

SMALL_STEPS = 60


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    for length in ([7, 3, 1, 5, 7], [7] * 5):
        net = new_network(3, 4, dtype=np.float64)
        data = rng.integers(0, 256, (7, 5)).astype(np.uint8)
        n, target = np.array(length), np.array([0, 1, 2, 0, 1])
        _, slope = loss_and_gradient(net, data, n, target)
        for a, g in zip(net.arrays(), slope.arrays()):
            at = np.argwhere(np.abs(g) > 1e-7)
            for i in map(tuple, at[rng.permutation(len(at))[:6]]):
                was, step = a[i], 1e-5
                a[i] = was + step
                up = loss_and_gradient(net, data, n, target)[0]
                a[i] = was - step
                down = loss_and_gradient(net, data, n, target)[0]
                a[i] = was
                assert abs((up - down) / (2 * step) - g[i]) < 1e-6


def plain_labels(net, window):
    """Probabilities of every byte by a loop over bytes, gates and states."""
    n = net.state.shape[2]
    squash = lambda a: a / (1 + abs(a))
    states = []
    for d, read in enumerate((window, window[::-1])):
        h, made = [0.0] * n, []
        for byte in read:
            u = [sum(float(net.state[d, i, j]) * h[j] for j in range(n)) for i in range(3 * n)]
            x = [float(v) for v in net.rows[d, :, byte]]
            z = [(1 + squash(x[i] + u[i])) / 2 for i in range(n)]
            r = [(1 + squash(x[n + i] + u[n + i])) / 2 for i in range(n)]
            c = [squash(x[2 * n + i] + r[i] * u[2 * n + i]) for i in range(n)]
            h = [c[i] + z[i] * (h[i] - c[i]) for i in range(n)]
            made.append(h)
        states.append(made if d == 0 else made[::-1])
    out = []
    for f, b in zip(*states):
        logit = [float(net.bias[k]) + sum(v * float(net.out[i, k]) for i, v in enumerate(f + b)) for k in range(len(net.bias))]
        e = [math.exp(v) for v in logit]
        out.append([v / sum(e) for v in e])
    return np.array(out)


@pytest.mark.parametrize("lengths", [[WINDOW] * 3, [1, 17, WINDOW, 5]])
def test_labels_like_a_plain_recurrence(lengths):
    rng = np.random.default_rng(5)
    net = new_network(3)
    windows = [rng.integers(0, 256, n).astype(np.uint8) for n in lengths]
    data = np.zeros((WINDOW, len(windows)), np.uint8)
    for i, w in enumerate(windows):
        data[: len(w), i] = w
    p = label_positions(net, data, np.array(lengths))
    for i, w in enumerate(windows):
        assert np.allclose(p[:, : len(w), i].T, plain_labels(net, list(w)), atol=1e-4)


def test_documents_pool_every_byte_once():
    net = new_network(4)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (1, 5, 40, 64, 65, 128, 130, 500, 70_000)]
    got = document_probabilities(net, pa.array([None, "", *texts]))
    assert not got[:2].any() and np.allclose(got[2:].sum(1), 1, atol=1e-4)
    raw = texts[4].encode()  # over one window: the last one reaches back
    first, last = plain_labels(net, list(raw[:WINDOW])), plain_labels(net, list(raw[-WINDOW:]))
    skip = 2 * WINDOW - len(raw)
    assert np.allclose(got[6], np.concatenate([first, last[skip:]]).mean(0), atol=1e-4)


LANGS = {"en": "the quick brown fox jumps over lazy dogs and runs away", "de": "über die straße läuft der große hund ganz schnell nach haus",
         "fr": "où est la bibliothèque près de l'école où j'étudie le français"}


def corpus(spark, n=240):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        rows.append((i, " ".join(rng.choice(LANGS[lang].split()) for _ in range(rng.randint(3, 60))), lang, "s", 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_awkward_rows_and_held_out(spark):
    docs = corpus(spark).unionAll(awkward(spark)).unionAll(documents(spark, ["12 34 !!", "北京", "x" * 200_000], 900))
    identifier = byte_gru.learn(docs, SMALL_STEPS)
    assert identifier.languages == ["de", "en", "fr"]
    rows = byte_gru.identify(docs, identifier).collect()
    assert len(rows) == docs.count()
    for r in rows:
        unknown = r["text"] is None or not any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == UNKNOWN) == unknown and 0 <= r["score"] <= 1 and (r["score"] == 0) == unknown
    twice = [tuple(r)[-2:] for r in rows if r["doc_id"] == 5 and r["n_chars"] == 1 and r["source"] == "src0"]
    assert len(twice) >= 2 and len({t for t in twice if t[0] == twice[-1][0]}) == 1
    for r in byte_gru.languages_of(docs.limit(300)).collect():
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert byte_gru.identify(clashing(docs), identifier).select("lang_pred").distinct().count() == 4
    assert "lang_pred" not in CLASHING


def test_nothing_to_learn_from(spark):
    from pyspark.sql import functions as F

    assert byte_gru.languages_of(empty(spark)).collect() == []
    unlabelled = corpus(spark, 20).withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in byte_gru.languages_of(unlabelled).collect()} == {(UNKNOWN, 0.0)}
    single = corpus(spark, 20).withColumn("lang", F.lit("en"))
    assert {(r["lang_pred"], r["score"]) for r in byte_gru.languages_of(single).collect()} == {("en", 1.0)}


def test_held_out_labels_are_never_read(spark):
    from pyspark.sql import functions as F

    docs = corpus(spark)
    wrong = docs.withColumn("lang", F.when(byte_gru._held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert byte_gru.training_sample(wrong) == byte_gru.training_sample(docs)


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(byte_gru, "SAMPLE_ROWS", 10)
    docs = corpus(spark)
    assert len(byte_gru.training_sample(docs.unionAll(docs))) == 10
    assert all(len(cut) <= WINDOW * byte_gru.WINDOWS_PER_ROW for _, cut in byte_gru.training_sample(docs))
    assert byte_gru._excerpts("é" * 1000).startswith("é".encode()) and len(byte_gru._excerpts("é" * 1000)) == WINDOW * byte_gru.WINDOWS_PER_ROW


def test_network_less_identifier():
    assert Identifier([], None).predict(pa.array(["a", None]))["lang_pred"].to_pylist() == [UNKNOWN, UNKNOWN]


def test_query_on_held_out_documents(spark):
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op11_byte_gru"](spark, SF_SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20 and sum(r["lang_pred"] == docs[r["doc_id"]] for r in held) >= 0.97 * len(held)
