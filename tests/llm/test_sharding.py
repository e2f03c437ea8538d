import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratabar.llm.sharding import communication_matrix, hypergeometric, shuffle_into_shards


def test_hypergeometric_is_exact():
    rng = np.random.default_rng(1)
    got = Counter(hypergeometric(rng, 7, 13, 9) for _ in range(20000))
    for k in range(8):
        p = math.comb(7, k) * math.comb(13, 9 - k) / math.comb(20, 9)
        assert abs(got[k] / 20000 - p) < 5 * math.sqrt(p * (1 - p) / 20000) + 1e-4
    big = [hypergeometric(rng, 5 * 10**9, 15 * 10**9, 10**8) for _ in range(200)]
    assert abs(np.mean(big) - 2.5e7) < 5 * 4400 / math.sqrt(200) and 3000 < np.std(big) < 6000
    assert hypergeometric(rng, 0, 5, 3) == 0 and hypergeometric(rng, 5, 1, 6) == 5


def test_matrix_sums():
    for seed in range(20):
        m = np.array(communication_matrix([5, 0, 17, 3], [7, 6, 6, 6], seed))
        assert m.sum(axis=1).tolist() == [5, 0, 17, 3] and m.sum(axis=0).tolist() == [7, 6, 6, 6] and (m >= 0).all()


@pytest.mark.parametrize("n,shards", [(0, 5), (3, 5), (103, 10)])
def test_laws(spark, n, shards):
    rows = [(i if i % 5 else None, "same" if i % 3 else (None if i % 2 else "é" * i), "x", 1) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string, place int").repartition(4)
    got = shuffle_into_shards(docs, shards).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n


def test_same_again_and_uniform(spark):
    docs = spark.range(0, 4000, 1, 7).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    a, b = ({r["doc_id"]: (r["shard"], r["slot"]) for r in shuffle_into_shards(docs, 8, seed=s).collect()} for s in (5, 5))
    assert a == b
    c = {r["doc_id"]: r["shard"] for r in shuffle_into_shards(docs, 8, seed=6).collect()}
    assert sum(a[k][0] == c[k] for k in a) < 4000 / 8 * 1.4
    # neighbours of the input land together as often as chance has it, and slots don't follow the input
    together = sum(a[k][0] == a[k + 1][0] for k in range(3999))
    assert abs(together - 500) < 110
    assert abs(np.corrcoef([k for k in a], [v[1] for v in a.values()])[0, 1]) < 0.06
    plan = shuffle_into_shards(docs, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("n,parts,shards", [(700, 7, 8), (41, 3, 40)])
def test_by_brute_force(spark, n, parts, shards):
    seed = 11
    docs = spark.range(0, n, 1, parts).selectExpr("id AS doc_id", "CAST(id % 9 AS string) AS text")
    place = F.monotonically_increasing_id().alias("place")
    rows = docs.select("doc_id", place, F.spark_partition_id().alias("source"))
    rows = rows.select("*", F.xxhash64(F.lit(seed), "place").alias("first"), F.xxhash64(F.lit(seed + 1), "place").alias("second")).collect()
    sources = sorted({r["source"] for r in rows})
    counts = [sum(r["source"] == s for r in rows) for s in sources]
    matrix = communication_matrix(counts, [n // shards + (j < n % shards) for j in range(shards)], seed)
    dealt = defaultdict(list)
    for s, sent in zip(sources, matrix, strict=True):
        own = iter(sorted((r for r in rows if r["source"] == s), key=lambda r: (r["first"], r["place"])))
        for shard, k in enumerate(sent):
            dealt[shard] += [next(own) for _ in range(k)]
    want = {}
    for shard, own in dealt.items():
        for slot, r in enumerate(sorted(own, key=lambda r: (r["second"] % (1 << 64), r["place"]))):
            want[r["doc_id"]] = (shard, slot)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in shuffle_into_shards(docs, shards, seed).collect()} == want
