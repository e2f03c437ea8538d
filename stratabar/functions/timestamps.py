"""Time columns of any unit as epoch milliseconds, and back."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, IntegralType, TimestampNTZType, TimestampType

#: Rows looked at to tell a unit.
SAMPLE_ROWS = 100
#: Means above are taken for milliseconds and microseconds.
MILLIS_ABOVE, MICROS_ABOVE = 1e12, 1e13


class TimestampFormat(Enum):
    """DATETIME_US_QUIRK: a timestamp whose microseconds are really milliseconds, so it shows dates in 1970."""

    DATETIME_MS = "datetime_ms"
    DATETIME_US = "datetime_us"
    DATETIME_NS = "datetime_ns"
    DATETIME_US_QUIRK = "datetime_us_quirk"
    UNIX_SECONDS = "unix_seconds"
    UNIX_MILLISECONDS = "unix_milliseconds"
    UNIX_MICROSECONDS = "unix_microseconds"


_DATETIMES = {TimestampFormat.DATETIME_MS, TimestampFormat.DATETIME_US, TimestampFormat.DATETIME_NS}


def _is_datetime(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (TimestampType, TimestampNTZType))


def _micros(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    return F.unix_micros(c.cast("timestamp") if isinstance(df.schema[column].dataType, TimestampNTZType) else c)


def detect_timestamp_format(df: DataFrame, column: str = "open_time") -> TimestampFormat:
    """By type, and by the mean of SAMPLE_ROWS values. One small action. Spark's timestamps have microseconds, so a
    proper one is DATETIME_US; it is the quirk only if its microseconds read as milliseconds of this era."""
    kind = df.schema[column].dataType
    datetime = _is_datetime(df, column)
    if not datetime and not isinstance(kind, (IntegralType, DoubleType, FloatType, DecimalType)):
        raise TypeError(f"{column} is {kind.simpleString()}, neither a number nor a timestamp")
    value = _micros(df, column) if datetime else F.col(column).cast("double")
    mean = df.filter(F.col(column).isNotNull()).limit(SAMPLE_ROWS).agg(F.avg(value)).first()[0]
    if mean is None:
        raise ValueError(f"{column} holds no values to tell its unit by")
    if datetime:
        return TimestampFormat.DATETIME_US_QUIRK if MILLIS_ABOVE < mean <= MICROS_ABOVE else TimestampFormat.DATETIME_US
    if mean > MICROS_ABOVE:
        return TimestampFormat.UNIX_MICROSECONDS
    return TimestampFormat.UNIX_MILLISECONDS if mean > MILLIS_ABOVE else TimestampFormat.UNIX_SECONDS


def parse_format(name: str | TimestampFormat) -> TimestampFormat:
    return name if isinstance(name, TimestampFormat) else TimestampFormat(name)


def to_millis(df: DataFrame, column: str, fmt: TimestampFormat) -> Column:
    """Epoch milliseconds of a column; finer digits are floored away."""
    c = F.col(column)
    if fmt in _DATETIMES:
        return F.floor(_micros(df, column) / 1000).cast("bigint")
    if fmt is TimestampFormat.DATETIME_US_QUIRK:
        return _micros(df, column)
    if fmt is TimestampFormat.UNIX_SECONDS:
        return F.floor(c.cast("decimal(38,6)") * 1000).cast("bigint") if not isinstance(df.schema[column].dataType, IntegralType) else c.cast("bigint") * 1000
    return c.cast("bigint") if fmt is TimestampFormat.UNIX_MILLISECONDS else F.floor(c.cast("decimal(38,0)") / 1000).cast("bigint")


def from_millis(millis: Column, fmt: TimestampFormat) -> Column:
    if fmt in _DATETIMES:
        return F.timestamp_millis(millis)
    if fmt is TimestampFormat.DATETIME_US_QUIRK:
        return F.timestamp_micros(millis)
    if fmt is TimestampFormat.UNIX_SECONDS:
        return F.floor(millis / 1000).cast("bigint")
    return millis if fmt is TimestampFormat.UNIX_MILLISECONDS else millis * 1000


def normalize_timestamp_to_datetime(df: DataFrame, column: str = "open_time", hint: TimestampFormat | None = None) -> tuple[DataFrame, TimestampFormat]:
    """column, and close_time if present, as timestamps of whole milliseconds; and the format they had."""
    fmt = hint or detect_timestamp_format(df, column)
    columns = [c for c in dict.fromkeys([column, "close_time"]) if c in df.columns]
    return df.withColumns({c: F.timestamp_millis(to_millis(df, c, fmt)) for c in columns}), fmt


def restore_original_timestamp_format(df: DataFrame, column: str, fmt: TimestampFormat) -> DataFrame:
    """The inverse, from timestamps; digits below milliseconds are not brought back."""
    columns = [c for c in dict.fromkeys([column, "close_time"]) if c in df.columns]
    return df.withColumns({c: from_millis(to_millis(df, c, TimestampFormat.DATETIME_MS), fmt) for c in columns})


def fix_timestamp_display(df: DataFrame, column: str = "open_time", fix_close_time: bool = True) -> DataFrame:
    """Timestamps whose microseconds are milliseconds, read anew as milliseconds."""
    columns = [column] + ["close_time"] * (fix_close_time and "close_time" in df.columns and column != "close_time")
    for c in columns:
        if not _is_datetime(df, c):
            raise TypeError(f"{c} is not a timestamp")
    return df.withColumns({c: F.timestamp_millis(_micros(df, c)) for c in columns})
