"""Sharding by a hypergeometric communication matrix: a uniform shuffle into shards of exact sizes."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratabar.llm.common import checkpointed, literal_rows, table

#: Source partitions are numbered modulo this, so the matrix stays small at every input size.
MAX_SOURCES = 4096
#: Ranges of the second permutation's key within a shard: no task sorts a whole shard.
RANGE_BITS = 10


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` rows, taken without replacement out of good + bad, are good. Exact to double precision at
    any size: the probabilities around the mode come from their ratios, far tails (beyond 12 deviations) are void."""
    total = good + bad
    if min(good, drawn) == 0:
        return 0
    low, high = max(0, drawn - bad), min(drawn, good)
    mean = drawn * good / total
    sd = math.sqrt(max(mean * (bad / total) * (total - drawn) / max(1, total - 1), 0.0))
    a, b = max(low, int(mean - 12 * sd) - 2), min(high, int(mean + 12 * sd) + 2)
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log((good - k) * (drawn - k)) - np.log((k + 1) * (bad - drawn + k + 1))
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    odds = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(odds, rng.random() * odds[-1], side="right"))


def communication_matrix(sources: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows: how many rows each source sends to each shard, drawn as a uniform shuffle would. Sums are exact."""
    rng, left, matrix = np.random.default_rng(seed), list(shards), []
    for n in sources:
        row, rest = [], sum(left)
        for j, room in enumerate(left):
            rest -= room
            row.append(n if not rest else hypergeometric(rng, room, rest, n))
            n -= row[-1]
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def shuffle_into_shards(docs: DataFrame, shards: int = 40, seed: int = 20240611, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, size (UTF-8 bytes + 16), text_crc32, shard, slot (gapless from 0 in a shard).

    Row counts of shards differ by one at most. First the narrow rows are checkpointed with their source partition
    and place, so retried tasks see the same numbering. Each source permutes its rows by a hash of the place, the
    drawn matrix cuts that order into pieces for the shards, and in its shard every row takes its slot by a second
    hash. Rows are told apart by place alone: repeated rows and null ids or texts (size 16, crc 0) are rows as any
    other. An empty table gives no rows. Other columns are not carried (join on id_col).
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = checkpointed(
        docs.select(
            F.col(id_col), (F.octet_length(body) + 16).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"),
            F.monotonically_increasing_id().alias("place"), F.pmod(F.spark_partition_id(), F.lit(MAX_SOURCES)).alias("source"),
        )
    )
    counts = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}  # MAX_SOURCES rows at most
    total = sum(counts.values())
    sources = sorted(counts)
    matrix = communication_matrix([counts[s] for s in sources], [total // shards + (j < total % shards) for j in range(shards)], seed)
    ends = json.dumps([{"source": s, "ends": np.cumsum(row).tolist()} for s, row in zip(sources, matrix, strict=True)])
    cuts = F.broadcast(literal_rows(spark, ends, "source:int,ends:array<bigint>"))  # MAX_SOURCES x shards numbers at most

    local = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "place"), "place")
    dealt = (
        rows.withColumn("at", F.row_number().over(local))
        .join(cuts, "source")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("at"))))
        .withColumn("key", F.xxhash64(F.lit(seed + 1), "place"))
        .withColumn("range", F.shiftrightunsigned("key", 64 - RANGE_BITS).cast("int"))
        .drop("ends", "at", "source")
    )
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "range").count().withColumn("first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("shard", "range").orderBy("key", "place")
    return (
        dealt.withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "range"])  # shards x 2^RANGE_BITS rows at most
        .select(id_col, "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).alias("slot"))
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_into_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
