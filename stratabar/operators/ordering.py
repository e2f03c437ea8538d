"""One total order of trades: time, then trade id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratabar.functions.intervals import bin_start

#: Bits of a packed key: a place inside a bin of up to 2^27 ms (37 hours), then the trade id.
OFFSET_BITS, ID_BITS = 27, 36


def order_columns(trades: DataFrame, time_col: str = "time", tie_col: str | None = "trade_id") -> list[str]:
    return [time_col] + [tie_col] * (tie_col is not None and tie_col in trades.columns)


def order_key(trades: DataFrame, interval_ms: int | None = None, packed: bool = False, time_col: str = "time", tie_col: str | None = "trade_id") -> Column:
    """What min_by and max_by order trades by. A struct of time and trade id always works, but Spark aggregates by it
    with sorts. packed=True promises trade ids from 0 to 2^36 - 1 (another one fails the query); in bins up to 37 hours
    both then fit one bigint, and the aggregation hashes."""
    columns = order_columns(trades, time_col, tie_col)
    if len(columns) == 1:
        return F.col(time_col)
    if packed and interval_ms is not None and interval_ms <= 1 << OFFSET_BITS:
        offset, tie = F.col(time_col) - bin_start(time_col, interval_ms), F.col(columns[1]).cast("bigint")
        broken = F.raise_error(F.concat(F.lit("packed=True needs ids from 0 to 2^36 - 1, not "), tie.cast("string"))).cast("bigint")
        return F.when((tie < 0) | (tie >= 1 << ID_BITS), broken).otherwise(F.shiftleft(offset.cast("bigint"), ID_BITS) + tie)
    return F.struct(*columns)


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def with_keys(rows: DataFrame, partition_cols: Sequence[str], bucket_ms: int | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """rows with never-null text forms of the partition columns and, given bucket_ms, the time bucket; the names of the
    former, and of all. Windows, aggregations and joins on all of them share one exchange, which joins that compare
    null-safely would not."""
    keys = [f"_k{i}" for i in range(len(partition_cols))]
    added = {k: F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for k, c in zip(keys, partition_cols, strict=True)}
    if bucket_ms is not None:
        added["_bucket"] = F.coalesce(bin_start("time", bucket_ms), F.lit(-(1 << 62)))
    return rows.withColumns(added) if added else rows, keys, [*keys, *(["_bucket"] if bucket_ms is not None else [])]
