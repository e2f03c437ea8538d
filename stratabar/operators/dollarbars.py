"""Trades to dollar bars, of a fixed or a daily threshold."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType
from pyspark.sql.window import Window

from stratabar.functions.intervals import TimeInterval, bin_start
from stratabar.operators.ordered import fold_ordered
from stratabar.operators.ordering import order_columns, with_keys
from stratabar.operators.timebars import taker_buys, total


def dollars(trades: DataFrame) -> Column:
    """What is accumulated: dollar_value where the table has it, else quote_quantity."""
    return F.col("dollar_value") if "dollar_value" in trades.columns else F.col("quote_quantity")


def bar_columns(key: Column) -> list[Column]:
    price, quantity, quote = F.col("price"), F.col("quantity"), F.col("quote_quantity")
    return [
        F.min("time").alias("open_time"), F.max("time").alias("close_time"),
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"),
        total(quantity).alias("volume"), total(quote).alias("quote_volume"),
        taker_buys(quantity).alias("taker_buy_base_volume"), taker_buys(quote).alias("taker_buy_quote_volume"), F.count(F.lit(1)).alias("num_trades"),
    ]


def label_fixed(trades: DataFrame, threshold, partition_cols: Sequence[str] = (), bucket_ms: int = TimeInterval.HOUR) -> DataFrame:
    """trades with bar_id (from 0 in each partition) and seq (place in time order), without a loop over trades.

    At most one bar closes per trade, so the bars closed after trade i are n(i) = i + min(0, min over j <= i of
    floor(S(j) / threshold) - j), S being the running sum; the bar of trade i is n(i - 1). Needs values >= 0.

    Running sums and minima are taken in two levels, so that a partition with very many trades is no single task:
    inside buckets of bucket_ms, over the buckets' totals, and together again.
    """
    order = order_columns(trades)
    rows, keys, group = with_keys(trades, partition_cols, bucket_ms)
    inside = Window.partitionBy(*group).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket

    rows = rows.withColumns({"_d": F.coalesce(dollars(trades), F.lit(0)), "_i": F.row_number().over(inside)}).withColumn("_s", F.sum("_d").over(upto))
    sums = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.sum("_d").alias("_sum"))
    sums = sums.select(*group, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_s0"))
    rows = rows.join(sums, group).withColumn("seq", F.col("_n0") + F.col("_i"))
    rows = rows.withColumn("_sum", F.col("_s0") + F.col("_s"))
    exact = isinstance(rows.schema["_sum"].dataType, DecimalType)  # whole division of decimals doesn't round
    full = F.call_function("div", F.col("_sum"), F.lit(Decimal(str(threshold)))) if exact else F.floor(F.col("_sum") / F.lit(threshold))
    rows = rows.withColumn("_gap", full.cast("bigint") - F.col("seq")).drop("_sum")
    least = rows.groupBy(*group).agg(F.min("_gap").alias("_least"))
    least = least.select(*group, F.least(F.coalesce(F.min("_least").over(earlier), F.lit(0)), F.lit(0)).alias("_m0"))
    rows = rows.join(least, group).withColumn("_m", F.coalesce(F.min("_gap").over(before), F.lit(0)))
    return rows.withColumn("bar_id", F.col("seq") - 1 + F.least("_m0", "_m")).select(*trades.columns, "seq", "bar_id")


def aggregate_trades_to_dollar_bars_fixed(
    trades: DataFrame, threshold, ensure_sorted: bool = True, partition_cols: Sequence[str] = (), bucket_ms: int = TimeInterval.HOUR
) -> DataFrame:
    """Bars that close once the running value reaches threshold; what is over is carried to the next bar, and one trade
    closes one bar at most. The last, open bar is included. No trades: no bars. Values must not be negative; a
    threshold given as Decimal over decimal values is exact."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    labelled = label_fixed(trades, threshold, partition_cols, bucket_ms)
    return labelled.groupBy(*partition_cols, "bar_id").agg(*bar_columns(F.col("seq")), total(dollars(trades)).alias("bar_dollar_volume"))


def calculate_daily_dollar_volume(trades: DataFrame, day_interval_ms: int = TimeInterval.DAY, partition_cols: Sequence[str] = ()) -> DataFrame:
    """day_start, daily_dollar_volume: sums of quote_quantity."""
    return trades.groupBy(*partition_cols, bin_start("time", day_interval_ms).alias("day_start")).agg(total(F.col("quote_quantity")).alias("daily_dollar_volume"))


def calculate_ema_daily_volume(daily: DataFrame, span: int = 20, min_periods: int | None = None, partition_cols: Sequence[str] = ()) -> DataFrame:
    """With ema_daily_volume: the mean of all volumes so far, each day back weighing 1 - 2 / (span + 1) times as much.
    Days are rows: a missing day doesn't count. Null before min_periods (span if not given) rows.

    The days of a partition are few, so the weights are applied to the array of volumes so far."""
    if span < 1:
        raise ValueError("span must be at least 1")
    q = 1 - 2 / (span + 1)
    upto = Window.partitionBy(*partition_cols).orderBy("day_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fold = F.aggregate(
        F.collect_list("daily_dollar_volume").over(upto),
        F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w")),
        lambda a, v: F.struct((a["v"] * q + v.cast("double")).alias("v"), (a["w"] * q + 1.0).alias("w")),
        lambda a: a["v"] / a["w"],
    )
    enough = F.count("daily_dollar_volume").over(upto) >= (span if min_periods is None else min_periods)
    return daily.withColumn("ema_daily_volume", F.when(enough, fold))


def calculate_dynamic_threshold(ema_daily_volume, target_bars_per_day: float):
    """The volume of a bar if a day's mean volume makes target_bars_per_day bars. A number or a column."""
    if target_bars_per_day <= 0:
        raise ValueError("target_bars_per_day must be positive")
    return ema_daily_volume / target_bars_per_day


def dynamic_thresholds(
    trades: DataFrame, target_bars_per_day: float, ema_span: int = 20, initial_threshold: float | None = None, recalculation_interval_ms: int = TimeInterval.DAY,
    partition_cols: Sequence[str] = (), lag_days: int = 0,
) -> DataFrame:
    """day_start, threshold, ema_daily_volume. Days before the mean exists take initial_threshold, or the first threshold
    that exists (a later day's: look-ahead). lag_days=1 uses the mean of the days before only."""
    daily = calculate_daily_dollar_volume(trades, recalculation_interval_ms, partition_cols)
    whole = Window.partitionBy(*partition_cols)
    by_day = whole.orderBy("day_start")
    counted = calculate_ema_daily_volume(daily, ema_span, 1, partition_cols)
    row, n = F.row_number().over(by_day), F.count(F.lit(1)).over(whole)
    counted = counted.withColumn("ema_daily_volume", F.when(row >= F.least(F.lit(ema_span), n), F.col("ema_daily_volume")))
    ema = F.lag("ema_daily_volume", lag_days).over(by_day) if lag_days else F.col("ema_daily_volume")
    own = calculate_dynamic_threshold(ema, target_bars_per_day)
    first = F.first(own, ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if not lag_days else F.lit(None)
    fallback = F.lit(float(initial_threshold)) if initial_threshold is not None else first
    return counted.select(*partition_cols, "day_start", F.coalesce(own, fallback).alias("threshold"), "ema_daily_volume")


class _DynamicLabels:
    """Bar numbers of ordered trades, with thresholds that change by day: the closed form of the fixed bars, day by day,
    the carry handed on."""

    def __init__(self, initial: float | None):
        self.initial, self.carry, self.closed, self.day, self.threshold = initial, 0.0, 0, None, None

    def __call__(self, rows: pa.Table) -> list[pa.Array]:
        d, day, own = (rows.column(c).to_numpy() for c in ("d", "day", "threshold"))
        ids, used = np.empty(len(d), np.int64), np.empty(len(d), np.float64)
        cuts = [0, *(np.flatnonzero(day[1:] != day[:-1]) + 1).tolist(), len(d)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if self.day is None:
                self.threshold = self.initial if self.initial is not None else rows.column("first")[0].as_py()
            elif day[a] != self.day and not np.isnan(own[a]):
                self.threshold = own[a]
            self.day = day[a]
            i = np.arange(1, b - a + 1)
            s = self.carry + np.cumsum(d[a:b])
            n = i + np.minimum(0, np.minimum.accumulate(np.floor(s / self.threshold).astype(np.int64) - i))
            ids[a] = self.closed
            ids[a + 1 : b] = self.closed + n[:-1]
            used[a:b] = self.threshold
            self.carry = float(s[-1] - n[-1] * self.threshold)
            self.closed += int(n[-1])
        return [pa.array(ids), pa.array(used)]


def aggregate_trades_to_dollar_bars_dynamic(
    trades: DataFrame, target_bars_per_day: float, ema_span: int = 20, initial_threshold: float | None = None, recalculation_interval_ms: int = TimeInterval.DAY,
    ensure_sorted: bool = True, partition_cols: Sequence[str] = (), lag_days: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(bars with threshold_used, thresholds by day). The threshold changes when a trade's day differs from the trade's
    before, ahead of that trade; the first day keeps the initial one. Carry and open bar go on across days.

    Trades are numbered by a fold over each partition's ordered stream (one number at a time is handed on per day, and
    memory is one batch); the bars are then aggregated as any other.
    """
    thresholds = dynamic_thresholds(trades, target_bars_per_day, ema_span, initial_threshold, recalculation_interval_ms, partition_cols, lag_days)
    whole = Window.partitionBy(*partition_cols).orderBy("day_start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table, keys, _ = with_keys(thresholds, partition_cols)
    table = table.select(*keys, "day_start", "threshold", F.first("threshold", ignorenulls=True).over(whole).alias("_first"))
    rows, _, _ = with_keys(trades.withColumn("day_start", bin_start("time", recalculation_interval_ms)), partition_cols)
    rows = rows.join(table, [*keys, "day_start"])
    rows = rows.withColumns({"_d": F.coalesce(dollars(trades), F.lit(0)).cast("double"), "_day": F.col("day_start"), "_own": F.col("threshold").cast("double")})
    labelled = fold_ordered(
        rows, partition_cols, order_columns(trades), {"d": "_d", "day": "_day", "threshold": "_own", "first": "_first"}, "bar_id bigint, threshold_used double",
        lambda: _DynamicLabels(initial_threshold),
    )
    key = F.struct(*order_columns(trades))
    bars = labelled.groupBy(*partition_cols, "bar_id").agg(
        *bar_columns(key), total(dollars(trades)).alias("bar_dollar_volume"), F.max_by("threshold_used", key).alias("threshold_used")
    )
    return bars, thresholds
