"""Best segmentation against plain dynamic programming; chunked scan; decoding by the library."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from llm_cases import awkward, clashing, documents, empty, prose

from ledgerline.llm import maxplus


@pytest.fixture(scope="module")
def pieces():
    return maxplus.encoder(maxplus.vocabulary())


def literal(pieces, text):
    """All segmentations by dynamic programming; of equals the smallest start wins at every end."""
    text = (text or "").replace("▁", " ")
    text = (" " + text).replace(" ", "▁") if text else ""
    best = [(0, None)] + [None] * len(text)
    for i in range(len(text)):
        options = [(j, pieces.pieces[text[i:j]]) for j in range(i + 1, min(len(text), i + 16) + 1) if text[i:j] in pieces.pieces]
        if not any(j == i + 1 for j, _ in options):
            options.append((i + 1, (-1, pieces.unk)))
        for j, (piece, score) in options:
            if best[j] is None or best[i][0] + score > best[j][0]:
                best[j] = (best[i][0] + score, (i, piece))
    out, j = [], len(text)
    while j:
        i, piece = best[j][1]
        out += [piece] if piece >= 0 else [pieces.byte[b] for b in reversed(text[i].encode())]
        j = i
    return out[::-1]


def _texts():
    rng = random.Random(3)
    letters = "abcdehlnorstABé ß你好🙂 \n\t\r;()▁1"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    return made + [None, "", " ", "  ", "\n", "▁", "hello world", "x" * 300, "   a    b  ", "the " * 50 + "\n\n  end\n", "\x00a"]


def test_words_match_dynamic_programming(pieces):
    texts = _texts()
    ids, counts = pieces.encode(pa.array(texts, pa.string()))
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [literal(pieces, t) for t in texts]
    decoded = pieces.decode(ids, counts).to_pylist()
    assert decoded == [(t or "").replace("▁", " ") for t in texts]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(maxplus.VOCABULARY))
    assert decoded == [library.decode(p.tolist()) for p in parts]


def test_score_is_the_librarys_best(pieces):
    """The library's lattice, reading the vocabulary as unigram, finds no better score."""
    model = maxplus.model_format.ModelProto()
    model.ParseFromString(maxplus.vocabulary())
    model.trainer_spec.model_type = maxplus.model_format.TrainerSpec.UNIGRAM
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    score = dict(pieces.pieces.values())
    for word in ["the", "hested", "theaaner", "reanblewh", "Hello", "ationer"]:
        best = library.nbest_encode(word, nbest_size=3)[0]  # more than one: the exact lattice
        mine = pieces.best("▁" + word)
        assert sum(score[i] for i in mine) == sum(score[i] for i in best)


def test_products_are_associative_and_scans_agree():
    rng = np.random.default_rng(1)
    m = rng.integers(-50, 0, (9, 5, 5))
    m[rng.random(m.shape) < 0.3] = maxplus.NEVER
    left = m[0:1]
    scanned = maxplus.prefix_products(m)
    for i in range(9):
        assert (np.where(scanned[i] < -10**6, -1, scanned[i]) == np.where(left[0] < -10**6, -1, left[0])).all()
        if i < 8:
            left = maxplus.product(left, m[i + 1:i + 2])


@pytest.mark.parametrize("chars", [16, 17, 64])
def test_giant_texts_equal_the_words_way(spark, pieces, chars):
    texts = [t for t in _texts() if t] + [prose(1, 400), "a" * 500, prose(2, 90).replace(" ", "")]
    got = {r["doc_id"]: r["ids"] for r in maxplus.encode(documents(spark, texts), giant_chars=0, chunk_chars=chars).collect()}
    assert [got[i] for i in range(len(texts))] == [literal(pieces, t) for t in texts]


def test_awkward_rows(spark, pieces):
    docs = clashing(awkward(spark))
    rows = maxplus.digest(maxplus.decode(maxplus.encode(docs, giant_chars=2000, chunk_chars=100))).collect()
    assert len(rows) == 12 and all(r["round_trip"] for r in rows)
    assert all(r["ids"] == literal(pieces, r["text"]) and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert maxplus.decode(maxplus.encode(empty(spark))).collect() == []


def test_fractional_scores_are_not_rounded():
    """A small unigram model: rounded, both readings of 'abc' would tie and the longest last piece would win."""
    model = maxplus.model_format.ModelProto()
    for name, score in [("a", -2.4), ("b", -2.0), ("c", -2.0), ("ab", -1.6), ("bc", -1.7), ("▁", -1.0)]:
        model.pieces.add(piece=name, score=score, type=1)
    small = maxplus.PieceEncoder(model.SerializeToString())
    names = [p.piece for p in model.pieces]
    assert [names[i] for i in small.best("abc")] == ["ab", "c"]  # -3.6 against -4.1
    assert small.pieces["b"][1] == -2 * maxplus.FIXED_POINT and small.unk == small.pieces["a"][1] - 10 * maxplus.FIXED_POINT
