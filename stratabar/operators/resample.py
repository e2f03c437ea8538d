"""Candles to coarser candles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabar.functions.intervals import bin_start, parse_interval
from stratabar.functions.timestamps import TimestampFormat, detect_timestamp_format, from_millis, parse_format, to_millis

PRICES_AND_VOLUME = ("open", "high", "low", "close", "volume")
#: Measures that are summed where present.
SUMMED = ("quote_asset_volume", "number_of_trades", "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume")
DEFAULT_OHLCV_COLUMNS = {c: c for c in ("open_time", "close_time", *PRICES_AND_VOLUME)}
#: Rows from which the source interval is told.
SAMPLE = 1000
OUTPUT_FORMATS = {"datetime": TimestampFormat.DATETIME_MS, "ms": TimestampFormat.UNIX_MILLISECONDS, "us": TimestampFormat.UNIX_MICROSECONDS, "s": TimestampFormat.UNIX_SECONDS}


def detect_source_interval(df: DataFrame, column: str = "open_time", sample: int = SAMPLE, fmt: TimestampFormat | None = None) -> int:
    """Seconds between rows: the most frequent difference among the first rows in time order, the smallest of equals."""
    millis = df.select(to_millis(df, column, fmt or detect_timestamp_format(df, column)).alias("t"))
    first = millis.filter("t IS NOT NULL").orderBy("t").limit(sample + 1)
    steps = first.select(F.expr("(t - lag(t) OVER (ORDER BY t)) DIV 1000").alias("step")).filter("step IS NOT NULL")  # sample rows at most
    best = steps.groupBy("step").count().orderBy(F.desc("count"), "step").first()
    if best is None or best["step"] <= 0:
        raise ValueError("the source interval can't be told: it needs rows at least a second apart")
    return int(best["step"])


def _targets(intervals: Mapping[str, int] | Sequence[str | int] | str | int) -> dict[str, int]:
    if isinstance(intervals, Mapping):
        return {k: parse_interval(v) for k, v in intervals.items()}
    if isinstance(intervals, (str, int)):
        intervals = [intervals]
    return {(i if isinstance(i, str) else f"{i}s"): parse_interval(i) for i in intervals}


class OHLCVAggregator:
    """Resamples candles whose interval is source_interval seconds.

    column_mapping names the columns where they aren't called as DEFAULT_OHLCV_COLUMNS says. A bar's time is the least
    source time in it, not the start of its bin.
    """

    def __init__(self, source_interval: int, timestamp_col: str = "open_time", column_mapping: Mapping[str, str] | None = None, timestamp_format: str | TimestampFormat | None = None):
        self.source_interval, self.timestamp_col = source_interval, timestamp_col
        self.column_mapping = dict(column_mapping or {})
        self.format = parse_format(timestamp_format) if timestamp_format is not None else None

    def _check(self, target: int) -> None:
        if target < self.source_interval or target % self.source_interval:
            raise ValueError(f"{target} s is no multiple of the source's {self.source_interval} s")

    def _prepared(self, df: DataFrame) -> tuple[DataFrame, TimestampFormat]:
        df = df.withColumnsRenamed({own: name for name, own in self.column_mapping.items() if own in df.columns and own != name})
        fmt = self.format or detect_timestamp_format(df, self.timestamp_col)
        times = [c for c in dict.fromkeys([self.timestamp_col, "close_time"]) if c in df.columns]
        return df.withColumns({c: to_millis(df, c, fmt) for c in times}), fmt

    def aggregate(self, df: DataFrame, target: int, output: TimestampFormat | None = None, partition_cols: Sequence[str] = ()) -> DataFrame:
        return self.aggregate_all(df, {"": target}, output, partition_cols).drop("interval")

    def aggregate_all(self, df: DataFrame, targets: Mapping[str, int], output: TimestampFormat | None = None, partition_cols: Sequence[str] = ()) -> DataFrame:
        """All targets in one pass and one shuffle, told apart by the column `interval`."""
        for target in targets.values():
            self._check(target)
        rows, fmt = self._prepared(df)
        t = self.timestamp_col
        kinds = F.array(*[F.struct(F.lit(k).alias("interval"), F.lit(v * 1000).cast("bigint").alias("length")) for k, v in targets.items()])
        spread = rows.select("*", F.inline(kinds)) if len(targets) > 1 else rows.select("*", *[F.lit(x).alias(n) for n, x in (("interval", next(iter(targets))), ("length", next(iter(targets.values())) * 1000))])
        aggs = [F.min(t).alias(t)]
        if "close_time" in rows.columns and t != "close_time":
            aggs.append(F.max("close_time").alias("close_time"))
        if all(c in rows.columns for c in PRICES_AND_VOLUME):
            aggs += [
                F.min_by("open", t).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", t).alias("close"),
                F.coalesce(F.sum("volume"), F.lit(0).cast(rows.schema["volume"].dataType)).alias("volume"),
            ]
        aggs += [F.coalesce(F.sum(c), F.lit(0).cast(rows.schema[c].dataType)).alias(c) for c in SUMMED if c in rows.columns]
        bars = spread.groupBy(*partition_cols, "interval", bin_start(F.col(t), F.col("length")).alias("bin")).agg(*aggs).drop("bin")
        if "ignore" in rows.columns:
            bars = bars.withColumn("ignore", F.lit(0))
        times = [c for c in dict.fromkeys([t, "close_time"]) if c in bars.columns]
        return bars.withColumns({c: from_millis(F.col(c), output or fmt) for c in times})


def aggregate_ohlcv(
    df: DataFrame, target_intervals, source_interval: str | int | None = None, timestamp_col: str = "open_time", output_format: str = "auto",
    timestamp_format: str | TimestampFormat | None = None, partition_cols: Sequence[str] = (),
) -> DataFrame | dict[str, DataFrame]:
    """A table for one target (a standard name or seconds), a dict of tables for a mapping or list of targets.

    Without source_interval or timestamp_format small samples are looked at; with both given nothing runs yet.
    output_format: auto (as it came), datetime, ms, us or s.
    """
    if output_format != "auto" and output_format not in OUTPUT_FORMATS:
        raise ValueError(f"unknown output format {output_format!r}")
    if source_interval is None and df.isEmpty():
        raise ValueError("the table is empty")
    fmt = parse_format(timestamp_format) if timestamp_format is not None else detect_timestamp_format(df, timestamp_col)
    source = parse_interval(source_interval) if source_interval is not None else detect_source_interval(df, timestamp_col, fmt=fmt)
    aggregator = OHLCVAggregator(source, timestamp_col, timestamp_format=fmt)
    output = None if output_format == "auto" else OUTPUT_FORMATS[output_format]
    made = {k: aggregator.aggregate(df, v, output, partition_cols) for k, v in _targets(target_intervals).items()}
    return next(iter(made.values())) if isinstance(target_intervals, (str, int)) else made

