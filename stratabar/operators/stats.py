"""Exploratory statistics of trades and bars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratabar.functions.intervals import TimeInterval
from stratabar.operators.ordering import order_columns, with_keys


def describe(df: DataFrame, column: str) -> DataFrame:
    """One row: n, nulls, total, mean, std (of a sample), least, median, greatest."""
    c = F.col(column)
    return df.agg(
        F.count(c).alias("n"), F.count_if(c.isNull()).alias("nulls"), F.sum(c).alias("total"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
        F.min(c).alias("least"), F.median(c).alias("median"), F.max(c).alias("greatest"),
    )


def coefficient_of_variation(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.stddev_samp(column) / F.avg(column)).alias("cv"))


def compare_bars(kinds: Mapping[str, DataFrame], count_cols: Mapping[str, str] | None = None) -> DataFrame:
    """A row per kind of bar: kind, bars, avg_trades, avg_seconds, cv_seconds."""
    seconds = (F.col("close_time") - F.col("open_time")) / 1000
    rows = [
        bars.agg(
            F.count(F.lit(1)).alias("bars"), F.avg((count_cols or {}).get(kind, "num_trades")).alias("avg_trades"), F.avg(seconds).alias("avg_seconds"),
            (F.stddev_samp(seconds) / F.avg(seconds)).alias("cv_seconds"),
        ).select(F.lit(kind).alias("kind"), "*")
        for kind, bars in kinds.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def tick_distribution(signed: DataFrame) -> DataFrame:
    """One row: ups, downs, net, up_share."""
    ups, downs = F.count_if(F.col("sign") == 1), F.count_if(F.col("sign") == -1)
    return signed.agg(ups.alias("ups"), downs.alias("downs"), (ups - downs).alias("net"), (ups / F.count("sign")).alias("up_share"))


def cumulative_signed_volume(signed: DataFrame, partition_cols: Sequence[str] = (), bucket_ms: int = TimeInterval.HOUR) -> DataFrame:
    """signed with cum_signed: the running sum of sign * quote_quantity, in two levels as other running sums here."""
    rows, keys, group = with_keys(signed, partition_cols, bucket_ms)
    rows = rows.withColumn("_v", F.col("sign") * F.col("quote_quantity"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    sums = rows.groupBy(*group).agg(F.sum("_v").alias("_sum"))
    rows = rows.join(sums.select(*group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_s0")), group)
    inside = Window.partitionBy(*group).orderBy(*order_columns(signed)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("cum_signed", F.col("_s0") + F.sum("_v").over(inside)).select(*signed.columns, "cum_signed")


def threshold_exceedances(cumulated: DataFrame, thresholds: Sequence[float], column: str = "cum_signed") -> DataFrame:
    """A row per threshold: how many rows have |column| at or above it. One pass for all."""
    counts = cumulated.agg(*[F.count_if(F.abs(column) >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("exceedances")) for i, t in enumerate(thresholds)])))


def taker_ratio(bars: DataFrame) -> DataFrame:
    """One row: the share of volume that buyers took, mean and greatest volume and trade count of a bar."""
    return bars.agg(
        (F.sum("taker_buy_volume") / F.sum("volume")).alias("taker_share"), F.avg("volume").alias("avg_volume"), F.max("volume").alias("max_volume"),
        F.avg("count").alias("avg_trades"), F.max("count").alias("max_trades"),
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles divide: over 0 it is infinite, and NaN for 0 / 0. Spark's own division fails the query there."""
    a, b = a.cast("double"), b.cast("double")
    over_zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf")))
    return F.when(b == 0, over_zero).otherwise(a / b)


def most_volatile(bars: DataFrame, n: int = 1) -> DataFrame:
    """The n bars of the greatest (high - low) / low, in per cent; the earliest of equals. A low of 0 gives infinity, or
    NaN if high is 0 too; NaN is above infinity, as in SQL. Bars without prices come last."""
    return bars.withColumn("volatility", ratio(F.col("high") - F.col("low"), F.col("low")) * 100).orderBy(F.desc("volatility"), "open_time").limit(n)


def sample_shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in an order that a hash of the key and the seed gives: the same at every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key)


def plan_size_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a table's size, from file sizes and the plan; nothing runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue())


def summary(df: DataFrame, *columns: str) -> DataFrame:
    """count, mean, stddev, min, quartiles and max of each column, as text."""
    return df.select(*columns).summary()


def row_slice(df: DataFrame, order: Sequence[str], offset: int, length: int | None = None) -> DataFrame:
    """length rows from the offset-th on in the given order, or all that follow. A negative offset counts from the end:
    row_slice(df, order, -n) is the last n rows."""
    if offset < 0:
        last = df.orderBy(*[F.desc(c) for c in order]).limit(-offset)
        return last.orderBy(*order).limit(length) if length is not None else last
    ordered = df.orderBy(*order).offset(offset)
    return ordered.limit(length) if length is not None else ordered


def average_rank(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """df with the rank of each value from 1 on, ties having the mean of their places; null for null.

    Values are counted first and ranges of them numbered in two levels, so no task holds or sorts all rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    ranged = counts.repartitionByRange(column).withColumn("_p", F.spark_partition_id())
    inside = Window.partitionBy("_p").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_in", F.coalesce(F.sum("count").over(inside), F.lit(0)))
    parts = own.groupBy("_p").agg(F.sum("count").alias("_n"), F.min(column).alias("_least"))
    before = Window.orderBy("_least").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    firsts = parts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranks = own.join(F.broadcast(firsts), "_p").select(column, (F.col("_first") + F.col("_in") + (F.col("count") + 1) / 2).alias(name))
    return df.join(ranks, column, "left").select(*df.columns, name)


def cast_or_keep(df: DataFrame, column: str, kind: str) -> DataFrame:
    """df with the column as `kind` if all its values can be read so, else as it is. One pass decides."""
    broken = df.agg(F.count_if(F.col(column).isNotNull() & F.expr(f"try_cast(`{column}` AS {kind})").isNull()).alias("n")).first()["n"]
    return df if broken else df.withColumn(column, F.col(column).cast(kind))
