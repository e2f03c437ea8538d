"""Trades to OHLCV time bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabar.functions.intervals import bin_start
from stratabar.operators.ordering import order_key, require

REQUIRED = ("time", "price", "quantity", "quote_quantity", "is_buyer_maker")


def total(c: Column) -> Column:
    """A sum that is 0 where all values are null."""
    return F.coalesce(F.sum(c), F.lit(0).cast("double"))


def taker_buys(c: Column) -> Column:
    """The part of c that buyers took: rows whose maker flag is false. Null flags don't count."""
    return F.sum(F.when(~F.col("is_buyer_maker"), c).otherwise(F.lit(0)))


def ohlcv_columns(key: Column) -> list[Column]:
    price, quantity, quote = F.col("price"), F.col("quantity"), F.col("quote_quantity")
    return [
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"),
        total(quantity).alias("volume"), total(quote).alias("quote_volume"), F.count(price).alias("count"),
        taker_buys(quantity).alias("taker_buy_volume"), taker_buys(quote).alias("taker_buy_quote_volume"),
    ]


def aggregate_trades_to_ohlcv(
    trades: DataFrame, interval_ms: int, ensure_sorted: bool = True, partition_cols: Sequence[str] = (), packed_ids: bool = False
) -> DataFrame:
    """Bars of interval_ms, for each value of partition_cols. Bins are aligned to the epoch; empty bins give no bar.

    One hash aggregation with map-side combine: a shuffle of one row per bin and map task. Trades are ordered by
    (time, trade_id) whatever their order of arrival, so ensure_sorted makes no difference; packed_ids promises small
    trade ids (see order_key).
    """
    require(trades, REQUIRED)
    if interval_ms <= 0:
        raise ValueError("interval_ms must be positive")
    keys = [F.col(c) for c in partition_cols]
    bars = trades.groupBy(*keys, bin_start("time", interval_ms).alias("open_time")).agg(*ohlcv_columns(order_key(trades, interval_ms, packed_ids)))
    return bars.withColumns({"close_time": F.col("open_time") + interval_ms - 1, "ignore": F.lit(0)}).select(
        *partition_cols, "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume", "ignore"
    )


def aggregate_trades_from_file(spark: SparkSession, path: str, interval_ms: int, output_path: str | None = None, **options) -> DataFrame:
    """Reads trades as Parquet, aggregates, and writes the bars if output_path is given."""
    bars = aggregate_trades_to_ohlcv(spark.read.parquet(path), interval_ms, **options)
    if output_path is not None:
        bars.write.mode("overwrite").parquet(output_path)
        return spark.read.parquet(output_path)
    return bars
