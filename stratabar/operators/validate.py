"""Reconciling two sets of candles, and checks of bars against their trades."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabar.functions.timestamps import detect_timestamp_format, to_millis

BAR_MEASURES = ("open", "high", "low", "close", "volume", "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume")
CANDLE_MEASURES = ("open", "high", "low", "close", "volume", "quote_asset_volume", "number_of_trades", "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume")
SAMPLES = 5


def _gap(c: str):
    return F.abs(F.col(c).cast("double") - F.col(f"{c}_other").cast("double"))


def differences(left: DataFrame, right: DataFrame, key: str, measures: Sequence[str], partition_cols: Sequence[str] = ()) -> DataFrame:
    """The inner join of both on key: key, each measure found on both sides, and it as `<measure>_other`."""
    keys = [*partition_cols, key]
    both = [m for m in measures if m in left.columns and m in right.columns]
    other = right.select(*keys, *[F.col(m).alias(f"{m}_other") for m in both])
    return left.select(*keys, *both).join(other, keys)


def difference_metrics(joined: DataFrame, measures: Sequence[str], tolerance: float) -> DataFrame:
    """A row per measure: measure, max_diff, mean_diff, mismatches, within. One pass over the joined rows, however many
    measures there are."""
    aggs = [a for m in measures for a in (F.max(_gap(m)).alias(f"{m}__max"), F.avg(_gap(m)).alias(f"{m}__mean"), F.count_if(_gap(m) > tolerance).alias(f"{m}__n"))]
    rows = [
        F.struct(F.lit(m).alias("measure"), F.col(f"{m}__max").alias("max_diff"), F.col(f"{m}__mean").alias("mean_diff"), F.col(f"{m}__n").alias("mismatches"), (F.col(f"{m}__max") <= tolerance).alias("within"))
        for m in measures
    ]
    return joined.agg(*aggs).select(F.inline(F.array(*rows)))


def differing_rows(joined: DataFrame, measures: Sequence[str], tolerance: float) -> DataFrame:
    return joined.filter(reduce(or_, [_gap(m) > tolerance for m in measures], F.lit(False)))


def validate_aggregation_accuracy(aggregated: DataFrame, reference: DataFrame, tolerance: float = 1e-6) -> dict:
    """passed, total_rows, matched_rows, unmatched_rows, differences (a DataFrame, or None), metrics by measure. Fails at
    once if the row counts differ, and if no times match."""
    rows, others = aggregated.count(), reference.count()
    failed = {"passed": False, "total_rows": rows, "matched_rows": 0, "unmatched_rows": max(rows, others), "differences": None, "metrics": {}}
    if rows != others:
        return failed | {"error": f"row counts differ: {rows} and {others}"}
    joined = differences(aggregated, reference, "open_time", BAR_MEASURES)
    measures = [m for m in BAR_MEASURES if m in joined.columns]
    metrics = {r["measure"]: {"max_diff": r["max_diff"], "mean_diff": r["mean_diff"], "within_tolerance": r["within"]} for r in difference_metrics(joined, measures, tolerance).collect()}
    matched = joined.count()
    if not matched:
        return failed | {"error": "no times match", "metrics": metrics}
    off = differing_rows(joined, measures, tolerance)
    passed = all(m["within_tolerance"] for m in metrics.values()) and off.isEmpty()
    return {"passed": passed, "total_rows": rows, "matched_rows": matched, "unmatched_rows": rows - matched, "differences": off, "metrics": metrics}


def format_validation_results(result: dict) -> str:
    lines = ["PASSED" if result["passed"] else "FAILED", f"rows {result['total_rows']}, matched {result['matched_rows']}"]
    if "error" in result:
        lines.append(result["error"])
    lines += [f"{m}: max {v['max_diff']}, mean {v['mean_diff']}{'' if v['within_tolerance'] else '  beyond tolerance'}" for m, v in result["metrics"].items()]
    return "\n".join(lines)


def print_validation_results(result: dict) -> None:
    print(format_validation_results(result))


@dataclass
class ValidationResult:
    total_rows: int
    matched_rows: int
    match_rate: float
    status: str
    max_differences: dict[str, float] = field(default_factory=dict)
    mean_differences: dict[str, float] = field(default_factory=dict)
    mismatches: dict[str, int] = field(default_factory=dict)
    samples: dict[str, list[dict]] = field(default_factory=dict)

    def __str__(self) -> str:
        lines = [f"{self.status}: {self.matched_rows} of {self.total_rows} rows matched ({self.match_rate:.4f} %)"]
        lines += [f"  {c}: max {self.max_differences[c]}, mean {self.mean_differences[c]}, mismatches {self.mismatches[c]}" for c in self.max_differences]
        return "\n".join(lines)


def compare_dataframes(original: DataFrame, aggregated: DataFrame, tolerance: float = 1e-10, timestamp_col: str = "open_time") -> ValidationResult:
    """Candles against candles; times of different units are compared as milliseconds."""
    left, right = (d.withColumn(timestamp_col, to_millis(d, timestamp_col, detect_timestamp_format(d, timestamp_col))) for d in (original, aggregated))
    joined = differences(left, right, timestamp_col, CANDLE_MEASURES)
    measures = [m for m in CANDLE_MEASURES if m in joined.columns]
    total, matched = max(original.count(), aggregated.count()), joined.count()
    if not matched:
        return ValidationResult(total, 0, 0.0, "FAILED: No matching timestamps")
    found = difference_metrics(joined, measures, tolerance).collect()
    samples = {r["measure"]: [x.asDict() for x in joined.filter(_gap(r["measure"]) > tolerance).orderBy(timestamp_col).limit(SAMPLES).collect()] for r in found if r["mismatches"]}
    return ValidationResult(
        total, matched, 100.0 * matched / total, "MISMATCHES_FOUND" if samples else "PERFECT_MATCH",
        {r["measure"]: r["max_diff"] for r in found}, {r["measure"]: r["mean_diff"] for r in found}, {r["measure"]: r["mismatches"] for r in found}, samples,
    )


def validate_row_counts(df: DataFrame, source_interval: int, target_interval: int, duration: float | None = None) -> bool:
    """Given the duration in seconds: whether it makes as many target bars as df has, give or take one. Else whether the
    target interval is no finer than the source."""
    if duration is not None:
        return abs(df.count() - duration / target_interval) < 2
    return target_interval / source_interval >= 1


def ohlc_violations(bars: DataFrame) -> DataFrame:
    """Bars whose high isn't the highest of the four prices, or whose low isn't the lowest."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return bars.filter((h < o) | (h < c) | (h < lo) | (lo > o) | (lo > c))


def conservation(trades: DataFrame, bars: DataFrame, count_col: str = "count") -> DataFrame:
    """One row: what trades and bars sum up to. Both are aggregated once; the two rows are joined as one."""
    a = trades.agg(F.sum("quantity").alias("trade_volume"), F.sum("quote_quantity").alias("trade_quote_volume"), F.count("price").alias("trades"), F.min("price").alias("least_price"), F.max("price").alias("greatest_price"))
    b = bars.agg(F.sum("volume").alias("bar_volume"), F.sum("quote_volume").alias("bar_quote_volume"), F.sum(count_col).alias("bar_trades"), F.min("low").alias("least_low"), F.max("high").alias("greatest_high"))
    return a.withColumn("_k", F.lit(0)).join(b.withColumn("_k", F.lit(0)), "_k").drop("_k")


def out_of_order(rows: DataFrame, time_col: str, id_col: str) -> DataFrame:
    """One row: how many rows have a lower time than the row of the next lower id."""
    from pyspark.sql.window import Window

    bucket = F.floor(F.col(id_col) / 100_000)
    w = Window.partitionBy("_b").orderBy(id_col)
    inside = rows.withColumn("_b", bucket).select("_b", id_col, time_col, F.lag(time_col).over(w).alias("_before"))
    edges = inside.groupBy("_b").agg(F.min_by(time_col, id_col).alias("_first"), F.max_by(time_col, id_col).alias("_last"), F.count_if(F.col(time_col) < F.col("_before")).alias("_n"))
    between = Window.orderBy("_b")  # a row per 100,000 ids
    return edges.withColumn("_cross", (F.col("_first") < F.lag("_last").over(between)).cast("int")).agg((F.sum("_n") + F.coalesce(F.sum("_cross"), F.lit(0))).alias("out_of_order"))
