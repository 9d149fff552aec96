"""Token store: ids by the tokenizer, Re-Pair round trips, random access."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm_cases import awkward, clashing, documents, empty, prose
from tokenizers import Tokenizer

from ledgerline.llm import repair

HARD = [
    None, "", " ", "it's I'll <|endoftext|>x we're", "İstanbul ǅ ﬁne J̌ J̌, Ǆ.", "a123b, 4,5 é! x!!  y z \x1c \x85q", "ΑΣ ΑΣ.",
    "ñ́ 你好, 世界. ábc, ½ Ⅷ ª ʰ. 🙂,", "a,'s b'!s 'twas ×2 ÷é é÷", "THE END*** of###it", "\xa0 x",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(repair.TOKENIZER))


def _literal(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_encoder_equals_the_tokenizer(tokenizer):
    with open(public_tokenizers.path(repair.TOKENIZER), "rb") as f:
        words = repair.WordEncoder(f.read())
    rng = random.Random(5)
    texts = HARD + ["".join(rng.choice("abAB éÉ,.'!s\n1½") for _ in range(60)) for _ in range(200)] + [prose(1, 500)]
    for _ in range(2):  # the second time from the cache
        ids, counts = words.encode(pa.array(texts, pa.string()), 1)
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [_literal(tokenizer, t) for t in texts]


def test_words_of_small_letters_skip_the_normalizer(tokenizer):
    """By a copy without normalizer and patterns, where the tokenizer's own leave such words alone."""
    from tokenizers import normalizers

    with open(public_tokenizers.path(repair.TOKENIZER), "rb") as f:
        words = repair.WordEncoder(f.read())
    rng = random.Random(8)
    small = ["".join(rng.choice(repair._SMALL) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    seen = []

    class Watched:
        def encode_batch_fast(self, texts, **kept):
            seen.extend(w for t in texts for w in t.split(" "))
            return plain.encode_batch_fast(texts, **kept)

    plain, words._plain = words._plain, Watched()
    odd = ["Ünal", "ſo", "ŵ", "ab1", "été.", "ßs", "ÿ"]
    ids, counts = words.encode(pa.array([" ".join(small), *odd], pa.string()), 1)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [_literal(tokenizer, t) for t in [" ".join(small), *odd]]
    assert set(small) <= set(seen) and not {"Ünal", "ſo", "ŵ", "ab1"} & set(seen)
    bare = Tokenizer.from_str(tokenizer.to_str())
    bare.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.StripAccents(), normalizers.Lowercase()])
    assert repair._plain(bare) is bare


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    for n, top in ((1, 3), (500, 3), (40_000, 40), (5000, 1)):
        ids = rng.integers(0, top, n).astype(np.uint16)
        counts = np.diff(np.unique(np.concatenate(([0, n], rng.integers(0, n + 1, 20)))))
        made = repair.compress(ids, counts, 50)
        grammar = repair.Grammar(made["left"], made["right"], made["length"], 50)
        first = np.append(made["first_symbol"], len(made["symbols"]))
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert len(parts) == len(first) - 1
        for i, p in enumerate(parts):  # each document from its own symbols
            assert grammar.expand(made["symbols"][first[i]:first[i + 1]]).tolist() == p.tolist()
        if n > 1000:
            assert len(made["symbols"]) < n / 1.5 and len(made["left"])


def test_overlapping_pairs_shrink():
    ids = np.zeros(4096, np.uint16)
    made = repair.compress(ids, np.array([4096]), 10)
    assert len(made["symbols"]) + len(made["left"]) < 30


def _repeated_pairs(made):
    """Pairs that occur twice without overlap inside documents."""
    first, seen, twice = set(made["first_symbol"].tolist()), {}, set()
    symbols = made["symbols"].tolist()
    for i in range(1, len(symbols)):
        if i not in first:
            at = seen.setdefault((symbols[i - 1], symbols[i]), i)
            if i - at > 1:
                twice.add((symbols[i - 1], symbols[i]))
    return twice


def test_rounds_go_on_until_no_pair_repeats():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 300, 700)
    copies = np.concatenate([np.append(passage, rng.integers(0, 300, rng.integers(1, 9))) for _ in range(64)])
    for ids, docs in ((rng.integers(0, 30, 3000), 11), (rng.integers(0, 2, 9000), 3), (copies, 1), (copies, 90), (rng.integers(0, 900, 200_000), 7)):
        ids = ids.astype(np.uint16)
        counts = np.diff(np.unique(np.concatenate(([0, len(ids)], rng.integers(1, len(ids), docs)))))
        made = repair.compress(ids, counts, 900)
        assert not _repeated_pairs(made)
        assert repair.Grammar(made["left"], made["right"], made["length"], 900).expand(made["symbols"]).tolist() == ids.tolist()
    assert len(repair.compress(copies.astype(np.uint16), np.array([len(copies)]), 900)["symbols"]) < 64 * 10


def test_numbers_are_packed_in_the_bits_they_need():
    for largest in (0, 65_535, 65_536, 70_000, 1 << 20, (1 << 31) - 1):
        for n in (0, 1, 7, 8, 1001):
            numbers = np.random.default_rng(n).integers(0, largest + 1, n).astype(np.uint32)
            data = repair.pack(numbers, largest)
            assert repair.unpack(data, n, largest).tolist() == numbers.tolist()
            assert len(data) == 2 * n + max(0, largest.bit_length() - 16) * ((n + 7) // 8)


def test_files_give_every_document_back(spark, tokenizer):
    texts = HARD + [prose(i, 50 + i) for i in range(60)]
    path = repair.write_ids(documents(spark, texts).repartition(4))
    rows = sorted(repair.read_ids(spark, path).collect(), key=lambda r: r["doc_id"])
    start = 0
    for r, t in zip(rows, texts):
        want = _literal(tokenizer, t)
        assert (r["ids"], r["n_tokens"], r["start"]) == (want, len(want), start)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    assert len(rows) == len(texts)


def test_awkward_rows(spark, tokenizer):
    docs = awkward(spark)
    path = repair.write_ids(clashing(docs))
    rows = repair.read_ids(spark, path).collect()
    want = sorted((str(r["doc_id"]), _literal(tokenizer, r["text"])) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["ids"]) for r in rows) == want
    total = sum(r["n_tokens"] for r in rows)
    ordered = sorted(rows, key=lambda r: r["start"])
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert ids == sorted(ids) and ordered[-1]["start"] + ordered[-1]["n_tokens"] == total
    assert repair.read_ids(spark, repair.write_ids(empty(spark))).collect() == []


def test_chosen_documents_are_expanded_alone(spark, monkeypatch):
    """3 of 1,000 documents: the same ids as reading everything, from their blocks and symbols only."""
    from pyspark.sql import functions as F

    from ledgerline.llm import repair

    docs = documents(spark, [prose(i % 90, 5 + i % 60) for i in range(1000)]).repartition(4)
    path = repair.write_ids(docs)
    whole = {r["doc_id"]: list(r["ids"]) for r in repair.read_ids(spark, path).collect()}
    asked = [3, 500, 999]
    found = repair.read_documents(spark, path, [*asked, 500, 123_456])
    assert {r["doc_id"]: list(r["ids"]) for r in found.collect()} == {i: whole[i] for i in asked}
    assert all(r["n_tokens"] == len(whole[r["doc_id"]]) for r in found.collect())
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(part" in scan or "EqualTo(part" in scan
    twice = documents(spark, ["a b", "a b c"]).withColumn("doc_id", F.lit(7).cast("long"))
    assert repair.read_documents(spark, repair.write_ids(twice), [7]).count() == 2
    assert repair.read_documents(spark, path, []).collect() == [] and repair.read_documents(spark, path, [-1]).collect() == []
    monkeypatch.setattr(repair, "MOST_ASKED", 2)
    with pytest.raises(ValueError):
        repair.read_documents(spark, path, [1, 2, 3])
