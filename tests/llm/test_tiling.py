"""Greedy string tiling against a slow, literal version."""

from __future__ import annotations

import random

from llm_cases import awkward, clashing, documents, empty, prose

from ledgerline.llm import tiling


def _literal(doc, item, least):
    """Mark the longest free common run, earliest first, until none is long enough."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for p in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (p + n < len(item) and d + n < len(doc) and free_i[p + n] and free_d[d + n]
                       and item[p + n] == doc[d + n]):
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (p, d, n)
        if best is None:
            return out
        out.append(best)
        p, d, n = best
        free_i[p:p + n] = [False] * n
        free_d[d:d + n] = [False] * n


def test_tiles_cover_like_the_literal_algorithm():
    rng = random.Random(7)
    for _ in range(150):
        item = [rng.randint(0, 5) for _ in range(rng.randint(0, 30))]
        parts = [item[a:a + 8] for a in range(0, len(item), 8)]
        rng.shuffle(parts)
        doc = [x for p in parts for x in [*p, rng.randint(6, 9)]] + [rng.randint(0, 5) for _ in range(rng.randint(0, 20))]
        for least in (2, 5):
            made, want = tiling.tiles(doc, item, least), _literal(doc, item, least)
            assert sorted(t[2] for t in made)[-1:] == sorted(t[2] for t in want)[-1:]
            assert abs(sum(t[2] for t in made) - sum(t[2] for t in want)) <= 2
            seen_i, seen_d = set(), set()
            for p, d, n in made:
                assert n >= least and item[p:p + n] == doc[d:d + n]
                assert not seen_i & set(range(p, p + n)) and not seen_d & set(range(d, d + n))
                seen_i |= set(range(p, p + n))
                seen_d |= set(range(d, d + n))


def _benchmark(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def _found(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def test_whole_reordered_and_partial_passages(spark):
    items = [prose(100 + i, 40) for i in range(6)]
    words = items[2].split()
    reordered = " ".join(words[20:] + ["between"] + words[:20])
    texts = [
        prose(1, 80), f"{prose(2, 30)} {items[0]} {prose(3, 30)}", items[1].upper().replace(" ", ",  "),
        f"{prose(4, 10)} {reordered}", " ".join(items[3].split()[:34]), " ".join(items[4].split()[:20]), None, "",
    ]
    docs = documents(spark, texts)
    want = {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert _found(tiling.contaminated_pairs(docs, _benchmark(spark, items))) == want
    assert _found(tiling.contaminated_pairs(docs, _benchmark(spark, items), block_bytes=300)) == want
    marked = tiling.with_verdict(docs, _benchmark(spark, items), block_bytes=300)
    assert {r["doc_id"] for r in marked.where("contaminated").collect()} == {1, 2, 3, 4}
    assert marked.count() == len(texts)


def test_awkward_rows_and_items(spark):
    items = [None, "", "too short", prose(5, 50), prose(2, 60), prose(2, 60)]
    docs = clashing(awkward(spark))
    pairs = [(r["doc_id"], r["item_id"]) for r in tiling.contaminated_pairs(docs, _benchmark(spark, items)).collect()]
    assert sorted(pairs, key=str) == sorted(
        [(0, 4), (0, 5), (5, 4), (5, 5), (5, 4), (5, 5), (None, 3)], key=str
    )
    assert tiling.with_verdict(docs, _benchmark(spark, items)).where("contaminated").count() == 4


def test_repeated_items_reach_the_driver_once(spark):
    items = _benchmark(spark, [prose(i, 30) for i in range(20)])
    many = spark.range(30_000).selectExpr("CAST(NULL AS LONG) item_id", f"'{prose(50, 40)}' text")
    bench = items.unionAll(many)
    blocks = list(tiling.benchmark_blocks(bench, block_bytes=2000))
    assert len(blocks) > 1 and sum(map(len, blocks)) == 21
    assert sorted(r["n"] for b in blocks for r in b) == [1] * 20 + [30_000]
    docs = documents(spark, [f"{prose(8, 9)} {prose(50, 40)}", prose(3, 30), prose(99, 30)])
    found = tiling.contaminated_pairs(docs, bench).groupBy("doc_id", "item_id").count().collect()
    assert {tuple(r) for r in found} == {(0, None, 30_000), (1, 3, 1)}
    assert {r["doc_id"] for r in tiling.with_verdict(docs, bench).where("contaminated").collect()} == {0, 1}


def test_empty_tables(spark):
    bench = _benchmark(spark, [prose(1, 30)])
    none = spark.createDataFrame([], "item_id long, text string")
    assert _found(tiling.contaminated_pairs(empty(spark), bench)) == set()
    assert _found(tiling.contaminated_pairs(documents(spark, [prose(1, 30)]), none)) == set()
    assert tiling.with_verdict(documents(spark, [prose(1, 30)]), none).where("contaminated").count() == 0


def test_repeated_seeds_are_expanded_once():
    """A long text of one word against an item of that word: candidates grow with the text, not with its product with the item."""
    import tracemalloc

    import pyarrow as pa

    from ledgerline.llm.tiling import Benchmark, words

    bench = Benchmark([1, 2], ["same " * 200, "other words that stand in no document at all here"])
    word, text, _ = words(pa.array(["a b c", "same " * 300_000, None]))
    tracemalloc.start()
    found = list(bench.candidates(word, text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(d, i) for d, i, _ in found] == [(1, 0)] and len(found[0][2]) == 300_000 - 4
    assert peak < 120e6
