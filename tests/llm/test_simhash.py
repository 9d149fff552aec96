"""SimHash fingerprints, links and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_cases import awkward, clashing, documents, empty, prose

from ledgerline.llm import simhash
from ledgerline.llm.components import components


def literal(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    texts = [None, "", " \n", "One", "one two three", "É É é x", "a b c d", "A b C d a b c d", prose(1, 300), "x\x1cy\x0bz q"]
    assert simhash.fingerprints(pa.array(texts, pa.string())).tolist() == [literal(t) for t in texts]


def _classes(values, bits):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def _family(n, seed, flips):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        x = rng.choice(out)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


@pytest.mark.parametrize("hot", [20_000, 12])
def test_links_connect_exactly_what_is_near(spark, hot):
    values = sorted(set(_family(500, 5, 6)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = components(simhash.links(nodes, len(values), 4, hot))
    root = dict((r["node"], r["root"]) for r in found.collect())
    made = [root.get(v, v) for v in signed]
    want = _classes(values, 4)
    assert len(set(zip(made, want))) == len(set(made)) == len(set(want))


def test_block_tables_miss_no_pair():
    rng = random.Random(1)
    for nodes in (10, 1 << 25, 1 << 32):
        masks = simhash.block_masks((1 << 64) - 1, simhash.blocks_for(nodes))
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in masks)


def test_large_bucket_leaves_as_a_forest():
    rng = np.random.default_rng(1)
    base = np.uint64(rng.integers(0, 1 << 63))
    fp = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64))
                   ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)))
    a, _ = simhash.linked(np.zeros(len(fp), np.int64), fp, 4, keep=5000)
    assert len(a) < len(fp)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(300, 300), (500, 501), (501, 500)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_match_brute_force(spark):
    base = [prose(i, 120) for i in range(20)]
    rng = random.Random(4)
    texts = list(base)
    for _ in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(["zulu", "yankee"])
        texts.append(" ".join(words))
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = [literal(t) for t in texts]
    assert [rows[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [rows[i]["component_id"] for i in range(len(texts))] == _classes(prints, 4)
    kept = simhash.first_of_each(documents(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(_classes(prints, 4)))
    assert kept.columns == documents(spark, []).columns


def test_awkward_rows(spark):
    docs = clashing(awkward(spark))
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 12
    zero = {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert zero == {1} and sum(r["fingerprint"] == "0" * 16 for r in rows) == 4
    assert {r["component_id"] for r in rows if r["doc_id"] == 5} == {0}
    kept = [r["doc_id"] for r in simhash.first_of_each(docs).collect()]
    assert sorted(kept, key=str) == sorted([0, 1, 4, 6, 7, 7, None], key=str)
    assert simhash.near_duplicates(empty(spark)).collect() == []
    assert simhash.first_of_each(empty(spark)).collect() == []


def test_a_hub_of_the_component_rounds_is_split(spark):
    """One node in a third of all links: every join on it is split."""
    from pyspark.sql import functions as F

    from ledgerline.llm import components

    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    links = spark.range(1, 9001).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 2000).alias("a"), F.col("id").alias("b"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = components._with_least(links.repartition(8))
        query = joined._jdf.queryExecution()
        query.toRdd().count()
        assert "SortMergeJoin(skew=true)" in query.executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
