"""N-gram Jaccard join by chosen paths: sets split on sampled shared tokens until their buckets are small enough."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from stratabar.llm.common import checkpointed, column, map_texts, table, whole_row
from stratabar.llm.components import components
from stratabar.llm.shingles import intersections, minima, shingle_set, sorted_groups

SIMILARITY = 0.8
#: Part of the pairs at SIMILARITY itself that the runs find, at least; closer pairs are found more often.
TARGET_RECALL = 0.999
#: Hash functions of a sketch that are compared: each samples one token of a set, the same one for sets that share
#: their least. A sketch has more where the runs need more, as no two runs share one.
FUNCTIONS = 64
#: Sets that are compared with each other at once; a bucket of so many isn't split.
BUCKET = 256
#: Splits of a bucket that stays larger; what is larger still is compared in pairs of blocks.
DEPTH = 3
#: Sets of a block, and bytes of their shingles, at most. A bucket has no more blocks than that takes, or than give each
#: task a pair of them: so a set is sent to a bounded number of tasks, not to one for each BUCKET sets like it.
BLOCK_SETS, BLOCK_BYTES = 8192, 16 << 20
#: Of FUNCTIONS, so many must agree for an exact comparison. Pairs at SIMILARITY fall below about once in 10^7.
AGREE = 34


def plan_runs(n_sets: int, depth: int = DEPTH, recall: float = TARGET_RECALL) -> tuple[int, int]:
    """(splits, runs). Larger inputs have larger buckets of unlike texts around common passages, so they may be split
    more often: once more for each factor of 4 beyond 4 million sets. A pair of similarity s stays together through d
    splits with chance s^d, so runs are repeated until a pair at SIMILARITY has met with chance `recall`."""
    depth += max(0, math.ceil(math.log(max(1, n_sets) / 4e6, 4)))
    return depth, math.ceil(math.log(1 - recall) / math.log(1 - SIMILARITY**depth))


def functions(n_sets: int) -> int:
    """Hash functions that the plan for n_sets sets, and so for any fewer, can do with."""
    return max(FUNCTIONS, math.prod(plan_runs(n_sets)))


def multipliers(n: int = FUNCTIONS) -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id_col, text_key, class_id, n_links, keeps; with carry also `row`, the whole row as a
    struct. id_col may be of any type with an order.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is SIMILARITY or more, checked
    exactly. class_id: the least id of all documents that links connect. n_links: documents of other rows whose text
    equals or is linked with this one's. keeps: true for the rows of the one text (of the least id) that stands for
    its class. text_key: MD5 of the text.

    Null texts and texts without words are linked with nothing: class_id is their own id, and they keep. Rows that
    repeat an id are rows as any other. Null ids are left out of the minimum; a class of null ids alone has class_id
    null. An empty table gives no rows.

    Copies of a text are merged first (map-side, so their number doesn't matter) and are one set from there on. Only
    sketches travel to the buckets; texts follow for sets that have a likely partner, to the bucket of the first run
    in which the two meet, so a pair is compared and counted once. Buckets return counts and spanning edges, never
    pairs. A bucket that no split makes small (near copies by the thousand) is compared in pairs of blocks, whose
    number is bounded by the tasks there are: n sets like each other cost n * n / 2 exact comparisons, shared by all
    tasks, but each is sent to sqrt(2 * tasks) of them in a run, however many they are.
    """
    spark = docs.sparkSession
    whole = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"), *([whole_row(docs)] if carry else []))
    whole = whole.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    rows = whole.select("id", "text", "key")
    kind = rows.schema["id"].dataType
    nodes = checkpointed(_nodes(rows, functions(docs.count())))
    depth, runs = plan_runs(nodes.count())
    leaves = _leaves(nodes, depth, runs)
    groups = _groups(leaves, nodes, runs)
    likely = checkpointed(_mapped(spark, groups, _likely, _schema(_LIKELY, kind)))
    texts = _texts(rows, likely)
    found = checkpointed(_mapped(spark, likely.join(texts, "key").select("g", "side", "run", "key", "rep", "copies", "leaves", "text"), _links, _schema(_LINKS, kind)))
    return _classes(whole.drop("text"), nodes, found).select(F.col("id").alias(id_col), *(["row"] if carry else []), "text_key", "class_id", "n_links", "keeps")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their class, one for each class, with all columns, whatever these are called. Of
    rows that repeat both id and text one stays, the one whose other columns have the least hash."""
    kept = jaccard_classes(docs, id_col, text_col, carry=True).filter("keeps")
    hashed = [f"`{f.name.replace('`', '``')}`" for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return kept.groupBy(id_col, "text_key").agg(F.min_by("row", F.xxhash64(*[F.col(f"row.{c}") for c in hashed])).alias("row")).select("row.*")


def _nodes(rows: DataFrame, n_functions: int) -> DataFrame:
    """key, rep (least id), copies, size, sketch: one row for each distinct text with words."""
    a = multipliers(n_functions)

    def compute(texts: list[str]) -> list[pa.Array]:
        sets = [shingle_set(t) for t in texts]
        return [pa.array([len(s) for s in sets], pa.int32()), pa.array([minima(s, a) for s in sets], pa.list_(pa.int32()))]

    sketched = map_texts(rows.filter(F.col("text").isNotNull()), "text", [F.col("key"), F.col("id")], "size int, sketch array<int>", compute)
    return (
        sketched.filter("size > 0").groupBy("key")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    )


def _leaves(nodes: DataFrame, depth: int, runs: int) -> DataFrame:
    """key, run, leaf, n, shingles: the bucket of at least two sets in which each run leaves a set, its sets, and the sum
    of their sizes. Every split of every run has a minimum of its own, so runs are independent."""

    def token(run: int, d: int):
        return F.get("sketch", F.lit(run * depth + d))

    paths = [F.struct(F.lit(r).alias("run"), F.xxhash64(F.lit(r), token(r, 0)).alias("leaf"), F.array(*[token(r, d) for d in range(1, depth)]).alias("rest")) for r in range(runs)]
    open_rows = nodes.select("key", "size", F.inline(F.array(*paths)))
    closed = []
    for d in range(depth):
        # cut off, so the join deals it anew and can split what meets a large bucket
        sizes = checkpointed(open_rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")).filter("n > 1"))
        met = checkpointed(open_rows.join(sizes, "leaf"))
        if d + 1 == depth:
            closed.append(met.select("key", "run", "leaf", "n", "shingles"))
            break
        closed.append(met.filter(F.col("n") <= BUCKET).select("key", "run", "leaf", "n", "shingles"))
        open_rows = met.filter(F.col("n") > BUCKET).select("key", "size", "run", F.xxhash64("leaf", F.get("rest", F.lit(d))).alias("leaf"), "rest")
        if d and open_rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, closed)


def _groups(leaves: DataFrame, nodes: DataFrame, runs: int) -> DataFrame:
    """The sets of each bucket with FUNCTIONS of their minima and all their leaves. Buckets beyond BUCKET
    become pairs of blocks: g is the bucket or the pair, side is -1, or 0 and 1 for the two blocks of a pair."""
    per_key = leaves.groupBy("key").agg(F.array(*[F.coalesce(F.max(F.when(F.col("run") == r, F.col("leaf"))), F.lit(0)) for r in range(runs)]).alias("leaves"))
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    enough = F.greatest(F.lit(math.ceil(math.sqrt(2 * tasks))), F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES))
    blocks = F.least(F.ceil(F.col("n") / BUCKET), enough).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(5), "key"), F.col("blocks")).cast("int")
    dealt = (
        leaves.withColumn("blocks", blocks).withColumn("mine", mine)
        .withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
        .select(
            "key", "run",
            F.xxhash64("leaf", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"),
            F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        )
    )
    return dealt.join(per_key.join(nodes, "key"), "key").select("g", "side", "run", "key", "rep", "copies", "leaves", "size", F.slice("sketch", 1, FUNCTIONS).alias("sketch"))


def _mapped(spark: SparkSession, rows: DataFrame, fn, schema: str) -> DataFrame:
    """fn over the groups of g. The number of tasks is given, so that small but laborious groups aren't put together."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "g").sortWithinPartitions("g").mapInArrow(fn, schema)


_LIKELY = "g bigint, side int, run int, key binary, copies bigint, leaves array<bigint>"
_LINKS = "key binary, links bigint, to_key binary"


def _schema(ddl: str, kind: DataType) -> StructType:
    """With rep, and to_rep beside to_key, of the ids' type."""
    out = StructType.fromDDL(ddl).add(StructField("rep", kind))
    return out.add(StructField("to_rep", kind)) if "to_key" in out.names else out


def _matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks > 1 else column.chunk(0).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _tiles(side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows to compare, BUCKET with BUCKET at a time: all with all, or, of a pair of blocks, one block with the other."""
    cut = lambda x: [x[k : k + BUCKET] for k in range(0, len(x), BUCKET)]
    if side[0] < 0:
        pieces = cut(np.arange(len(side)))
        yield from ((a, b) for k, a in enumerate(pieces) for b in pieces[k:])
    else:
        yield from ((a, b) for a in cut(np.flatnonzero(side == 0)) for b in cut(np.flatnonzero(side == 1)))


def _open_pairs(i: np.ndarray, j: np.ndarray, size: np.ndarray, leaves: np.ndarray, run: int) -> np.ndarray:
    """Of the pairs of a tile, those of fitting sizes that no earlier run has in one leaf."""
    a, b = size[i][:, None].astype(np.int64), size[j][None, :].astype(np.int64)
    out = 10 * np.minimum(a, b) >= 8 * np.maximum(a, b)
    if i[0] == j[0]:
        out &= i[:, None] < j[None, :]
    for r in range(run):
        x, y = leaves[i, r][:, None], leaves[j, r][None, :]
        out &= (x != y) | (x == 0)
    return out


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, the sets with a partner there whose sketch agrees often enough."""
    for _, rows in sorted_groups(batches):
        size, run = rows.column("size").to_numpy(), rows.column("run")[0].as_py()
        sketch, leaves = _matrix(rows.column("sketch"), np.int32), _matrix(rows.column("leaves"), np.int64)
        paired = np.zeros(len(size), bool)
        for i, j in _tiles(rows.column("side").to_numpy()):
            unknown = ~(paired[i][:, None] & paired[j][None, :])  # two that have a partner each needn't be looked at
            if not unknown.any():
                continue
            x, y = np.nonzero(unknown & _open_pairs(i, j, size, leaves, run))
            for k in range(0, len(x), 8192):
                a, b = i[x[k : k + 8192]], j[y[k : k + 8192]]
                near = (sketch[a] == sketch[b]).sum(axis=1) >= AGREE
                paired[a[near]] = paired[b[near]] = True
        if paired.any():
            yield from rows.select(["g", "side", "run", "key", "copies", "leaves", "rep"]).filter(pa.array(paired)).combine_chunks().to_batches()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, the documents linked with each set, and edges that connect what the links connect."""
    for _, rows in sorted_groups(batches):
        side, run = rows.column("side").to_numpy(), rows.column("run")[0].as_py()
        sets = [shingle_set(t.as_py()) for t in rows.column("text")]
        size, leaves = np.array([len(s) for s in sets]), _matrix(rows.column("leaves"), np.int64)
        copies, n = rows.column("copies").to_numpy(), len(side)
        links, root = np.zeros(n, np.int64), list(range(n))

        def find(x: int, root: list[int] = root) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, j in _tiles(side):
            open_pairs = _open_pairs(i, j, size, leaves, run)
            if not open_pairs.any():
                continue
            both = intersections([sets[k] for k in i], [sets[k] for k in j]).astype(np.int64)
            linked = open_pairs & (10 * both >= 8 * (size[i][:, None] + size[j][None, :] - both))
            links[i] += linked @ copies[j]
            links[j] += linked.T @ copies[i]
            x, y = np.nonzero(linked)
            for a, b in zip(i[x].tolist(), j[y].tolist(), strict=True):
                if root[a] != root[b]:
                    root[find(a)] = find(b)
        own = np.flatnonzero(links).tolist()
        if own:
            to = pa.array([find(k) for k in own])
            at, whole = pa.array(own), rows.select(["key", "rep"]).combine_chunks()
            key, rep = whole.column("key").combine_chunks(), whole.column("rep").combine_chunks()
            yield pa.RecordBatch.from_arrays([key.take(at), pa.array(links[own]), key.take(to), rep.take(at), rep.take(to)], ["key", "links", "to_key", "rep", "to_rep"])


def _texts(rows: DataFrame, likely: DataFrame) -> DataFrame:
    """key, text for the sets with a likely partner, from the row of the least id."""
    wanted = likely.select("key", "rep").distinct()
    own = rows.join(wanted.withColumnRenamed("key", "wanted"), (F.col("key") == F.col("wanted")) & F.col("id").eqNullSafe(F.col("rep")))
    return own.groupBy("key").agg(F.first("text").alias("text"))


def _classes(rows: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    kind = f"struct<none:boolean,rep:{nodes.schema['rep'].dataType.simpleString()},key:binary>"

    def node(rep: str, key: str):  # null ids come last
        return F.struct(F.col(rep).isNull().alias("none"), F.col(rep).alias("rep"), F.col(key).alias("key"))

    tied = components(found.select(node("rep", "key").alias("a"), node("to_rep", "to_key").alias("b")))
    none = F.lit(None)
    blank = {"rep": none.cast(nodes.schema["rep"].dataType), "copies": none.cast("bigint"), "links": none.cast("bigint"), "root": none.cast(kind)}
    parts = [
        nodes.select("key", "rep", "copies", blank["links"].alias("links"), blank["root"].alias("root")),
        found.select("key", blank["rep"].alias("rep"), blank["copies"].alias("copies"), "links", blank["root"].alias("root")),
        tied.select(F.col("node.key").alias("key"), blank["rep"].alias("rep"), blank["copies"].alias("copies"), blank["links"].alias("links"), "root"),
    ]
    known = reduce(DataFrame.unionByName, parts).groupBy("key").agg(
        F.max("rep").alias("rep"), (F.max("copies") - 1 + F.coalesce(F.sum("links"), F.lit(0))).alias("n_links"), F.max("root").alias("root")
    )
    own_class = F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("root.rep"))
    known = checkpointed(known.select("key", "rep", "n_links", own_class.alias("class_id"), (F.coalesce("root.key", "key") == F.col("key")).alias("stands")))
    own = rows.join(known, "key", "left")
    alone = F.col("stands").isNull()
    return own.select(
        "id", *(["row"] if "row" in rows.columns else []), F.hex("key").alias("text_key"),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(alone, F.lit(True)).otherwise(F.col("stands") & F.col("id").eqNullSafe(F.col("rep"))).alias("keeps"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
