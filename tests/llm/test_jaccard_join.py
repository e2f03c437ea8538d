import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratabar.llm import jaccard_join
from stratabar.llm.components import components
from stratabar.llm.jaccard_join import jaccard_classes, one_of_each, op6_jaccard_join, plan_runs
from stratabar.llm.shingles import intersections, minima, shingle_set


def plain_shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """doc_id -> (class, links), for distinct ids."""
    sets = {i: plain_shingles(t) for i, t in rows}
    texts = dict(rows)
    root = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    near = {(a, b) for own in by.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    for a, b in near:
        a, b = min(a, b), max(a, b)
        both = len(sets[a] & sets[b])
        if texts[a] == texts[b] or 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (find(i), links[i]) for i in sets}


def near_copies(n, seed, words=60, edits=2):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"w{rng.randrange(5000)}"
        out.append(" ".join(own))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id bigint, text string, class_id int").repartition(5)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_classes(docs).collect()}
    assert got == brute(rows)


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    check(spark, rows)
    query = op6_jaccard_join(spark, "/root/testdata/sf0.01")
    assert query.columns == ["doc_id", "class_id", "n_links"] and {r[0]: tuple(r[1:]) for r in query.collect()} == brute(rows)


def test_large_group_in_blocks(spark, monkeypatch):
    """A group of near copies that no split makes small, a passage in many documents, many exact copies."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 16)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 40)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(55))
    texts = near_copies(120, 1) + near_copies(30, 2, edits=1) + ["copy of one text that is here very often indeed"] * 40
    texts += [passage + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(80)]
    check(spark, list(enumerate(texts)))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (5, "a  b"), (6, "a b c"), (7, "x " * 30000), (8, "x " * 30001), (9, ""), (10, "one two three four five six"), (11, "one two three four five six")]
    docs = spark.createDataFrame([*rows, (None, "nobody's text is here alone"), (None, "nobody's text is here alone"), (12, "twice the same row"), (12, "twice the same row"), (13, "id with text one"), (13, "id with text two and more")], "doc_id bigint, text string")
    got = [(r["doc_id"], r["class_id"], r["n_links"], r["keeps"]) for r in jaccard_classes(docs).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 1, 0, True), (2, 2, 0, True), (3, 3, 0, True), (4, 4, 1, True), (5, 4, 1, False), (6, 6, 0, True), (7, 7, 1, True), (8, 7, 1, False), (9, 9, 0, True), (10, 10, 1, True), (11, 10, 1, False),
         (None, None, 1, True), (None, None, 1, True), (12, 12, 1, True), (12, 12, 1, True), (13, 13, 0, True), (13, 13, 0, True)], key=str,
    )
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 3, 4, 6, 7, 9, 10, 12, 13, 13]
    assert kept.filter("doc_id IS NULL").count() == 1
    assert jaccard_classes(docs.limit(0)).count() == 0


def test_plan_of_runs():
    depth, runs = plan_runs(10**6)
    assert (1 - 0.8**depth) ** runs <= 1 - jaccard_join.TARGET_RECALL and depth == jaccard_join.DEPTH
    deeper, more = plan_runs(10**10)
    assert deeper > depth and more > runs and (1 - 0.8**deeper) ** more <= 1 - jaccard_join.TARGET_RECALL


@pytest.mark.parametrize("n_sets", [10**6, 15 * 10**6, 10**8])
def test_recall_of_the_runs(spark, monkeypatch, n_sets):
    """Pairs of sketches that agree at SIMILARITY meet in some leaf of the runs as often as the plan says."""
    monkeypatch.setattr(jaccard_join, "BUCKET", 0)  # split all the way
    depth, runs = plan_runs(n_sets)
    rng, n = np.random.default_rng(2), 3000
    size = jaccard_join.functions(n_sets)
    one, two = rng.integers(0, 1 << 31, (2, n, size))
    two = np.where(rng.random((n, size)) < jaccard_join.SIMILARITY, one, two)
    rows = [(k, s.tolist()) for pair in (one, two) for k, s in enumerate(pair)]
    nodes = spark.createDataFrame([(f"{i}", k, 100, s) for i, (k, s) in enumerate(rows)], "key string, pair int, size int, sketch array<int>")
    met = jaccard_join._leaves(nodes, depth, runs).join(nodes.select("key", "pair"), "key")
    share = met.groupBy("leaf", "pair").count().filter("count = 2").select("pair").distinct().count() / n
    assert share >= 0.9975


def test_recall_at_ten_billion_sets():
    """The same by the functions that each run takes, for plans too large to try on tables."""
    depth, runs = plan_runs(10**10)
    agree = np.random.default_rng(3).random((20_000, jaccard_join.functions(10**10))) < jaccard_join.SIMILARITY
    met = np.zeros(len(agree), bool)
    for r in range(runs):
        met |= agree[:, r * depth : (r + 1) * depth].all(axis=1)
    assert met.mean() >= 0.998


def test_near_copies_are_sent_to_few_tasks(spark):
    """Rows that the buckets get grow as the near copies do, not with their square."""
    rows = []
    for n in (1000, 4000, 20_000):
        base = np.random.default_rng(1).integers(0, 1 << 31, jaccard_join.FUNCTIONS).tolist()
        nodes = spark.range(n).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), F.col("id").alias("rep"), F.lit(1).cast("bigint").alias("copies"), F.lit(300).alias("size"), F.array(*map(F.lit, base)).alias("sketch"))
        depth, runs = plan_runs(n)
        rows.append(jaccard_join._groups(jaccard_join._leaves(nodes, depth, runs), nodes, runs).count())
        blocks = max(-(-n // jaccard_join.BLOCK_SETS), 3)  # of 4 tasks
        assert rows[-1] == n * runs * blocks
    assert rows[2] == 20 * rows[0]


@pytest.mark.parametrize("kind", ["string", "int", "decimal(9,2)", "date"])
def test_ids_of_any_type(spark, kind):
    made = "date_add(date'2024-01-01', k)" if kind == "date" else f"CAST(k AS {kind})"
    texts = near_copies(6, 9, edits=1) + ["another text of which there is one"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0])], "k int, text string").selectExpr(f"{made} AS doc_id", "text", "1 AS row", "2 AS key", "3 AS rep", "4 AS keeps", "5 AS id")
    got = {str(r["doc_id"]): str(r["class_id"]) for r in jaccard_classes(docs).collect()}
    ids = [str(r["doc_id"]) for r in docs.collect()]
    want = brute(list(enumerate(texts)))
    assert all(got[ids[k]] == ids[want[k][0]] for k in want) and got["None"] == got[ids[0]]
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for c, _ in want.values()})


def test_no_two_runs_share_a_function():
    for n_sets in (0, 10**6, 2 * 10**7, 10**8, 10**9, 10**10):
        depth, runs = plan_runs(n_sets)
        assert depth * runs <= jaccard_join.functions(n_sets) <= jaccard_join.functions(4 * n_sets)
    assert jaccard_join.functions(10**6) == jaccard_join.FUNCTIONS
    assert np.array_equal(jaccard_join.multipliers(500)[: jaccard_join.FUNCTIONS], jaccard_join.multipliers())


def test_shingles():
    a, b = "a b c d e f g h", "a b c d e f x h"
    assert len(shingle_set(a)) == 4 and intersections([shingle_set(a)], [shingle_set(b)])[0, 0] == len(plain_shingles(a) & plain_shingles(b))
    assert np.array_equal(shingle_set("a b"), shingle_set("a   b\n")) and not len(shingle_set(None))
    m = jaccard_join.multipliers()
    x, y = (shingle_set(t) for t in near_copies(2, 3, 400, 6))
    j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((minima(x, m) == minima(y, m)).mean() - j) < 0.25


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}
