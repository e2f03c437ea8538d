"""Which archive files there are, which are wanted, and what they are called."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabar.schemas import KLINE_LIKE, DataType, Frequency, Market

CATALOG_SCHEMA = "filename string, date date, url string, size_bytes bigint, last_modified string, symbol string, data_type string, market string, frequency string"
#: Which types each market offers.
MARKET_DATA_TYPES: dict[Market, frozenset[DataType]] = {
    Market.SPOT: frozenset({DataType.KLINES, DataType.TRADES, DataType.AGG_TRADES, DataType.BOOK_TICKER, DataType.BOOK_DEPTH}),
    Market.USD_M: frozenset(set(DataType)),
    Market.COIN_M: frozenset(set(DataType)),
    Market.OPTION: frozenset(),
}
#: Types that come by the day only.
DAILY_TYPES = frozenset({DataType.METRICS, DataType.BOOK_DEPTH})


@dataclass(frozen=True)
class DataConfig:
    """What is asked for: dates are inclusive. Type and market may be given by their values. An interval is needed by
    candles and means nothing to other types."""

    symbol: str
    data_type: DataType
    market: Market = Market.USD_M
    start: date | str | None = None
    end: date | str | None = None
    interval: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "data_type", DataType(self.data_type))
        object.__setattr__(self, "market", Market(self.market))
        if self.data_type in KLINE_LIKE and not self.interval:
            raise ValueError(f"{self.data_type.value} needs an interval")

    @property
    def bars(self) -> str | None:
        """The interval where the type has one."""
        return self.interval if self.data_type in KLINE_LIKE else None


def parse_date(value: date | str) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value)


def parse_date_range(start: date | str, end: date | str) -> tuple[date, date]:
    a, b = parse_date(start), parse_date(end)
    if a > b:
        raise ValueError("the range ends before it starts")
    return a, b


class ArchiveRepository:
    """Paths below the root of an archive."""

    def __init__(self, base_url: str):
        self.base_url = base_url.rstrip("/")

    @staticmethod
    def build_prefix(config: DataConfig, frequency: Frequency) -> str:
        market = "spot" if config.market is Market.SPOT else f"futures/{config.market.value}" if config.market in (Market.USD_M, Market.COIN_M) else config.market.value
        return "/".join(["data", market, frequency.value, config.data_type.value, config.symbol, *([config.bars] if config.bars else [])]) + "/"

    @staticmethod
    def validate_config(config: DataConfig) -> None:
        if config.data_type not in MARKET_DATA_TYPES[config.market]:
            raise ValueError(f"{config.market.value} has no {config.data_type.value}")

    def file_url(self, config: DataConfig, frequency: Frequency, day: date) -> tuple[str, str]:
        stamp = day.strftime("%Y-%m" if frequency is Frequency.MONTHLY else "%Y-%m-%d")
        filename = f"{config.symbol}-{config.bars or config.data_type.value}-{stamp}.zip"
        return f"{self.base_url}/{self.build_prefix(config, frequency)}{filename}", filename


def get_data_frequency(data_type: DataType) -> Frequency:
    return Frequency.DAILY if data_type in DAILY_TYPES else Frequency.MONTHLY


def get_file_extension(data_type: DataType) -> str:
    return "zip"


def _month_end(d: date) -> date:
    return (d.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)


def determine_optimal_frequency(start: date | str, end: date | str) -> list[tuple[date, date, Frequency]]:
    """Whole months by the month, the rest by the day; neighbours of one kind are one range."""
    at, end = parse_date_range(start, end)
    out: list[tuple[date, date, Frequency]] = []
    while at <= end:
        last = _month_end(at)
        kind = Frequency.MONTHLY if at.day == 1 and last <= end else Frequency.DAILY
        stop = min(last, end)
        if out and out[-1][2] is kind:
            out[-1] = (out[-1][0], stop, kind)
        else:
            out.append((at, stop, kind))
        at = stop + timedelta(days=1)
    return out


def frequency_plan(spark: SparkSession, start: str, end: str) -> DataFrame:
    """The same plan as a table: start, end, frequency. Months of the range, then islands of one kind."""
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("m"))
    a = F.greatest("m", F.lit(start).cast("date"))
    b = F.least(F.last_day("m"), F.lit(end).cast("date"))
    kind = F.when((a == F.col("m")) & (b == F.last_day("m")), Frequency.MONTHLY.value).otherwise(Frequency.DAILY.value)
    spans = months.select(a.alias("a"), b.alias("b"), kind.alias("frequency"))
    islands = spans.selectExpr("*", "row_number() OVER (ORDER BY a) - row_number() OVER (PARTITION BY frequency ORDER BY a) AS island")  # a row per month
    return islands.groupBy("frequency", "island").agg(F.min("a").alias("start"), F.max("b").alias("end")).select("start", "end", "frequency")


def date_list(spark: SparkSession, start: str, end: str, frequency: Frequency = Frequency.DAILY) -> DataFrame:
    """The days of a range, or the first days of its months."""
    first = F.lit(start).cast("date")
    monthly = frequency is Frequency.MONTHLY
    step = F.expr("interval 1 month" if monthly else "interval 1 day")
    return spark.range(1).select(F.explode(F.sequence(F.trunc(first, "month") if monthly else first, F.lit(end).cast("date"), step)).alias("date"))


def parse_listings(listings: DataFrame, base_url: str, xml_col: str = "xml", data_type: str = "", market: str = "", frequency: str = "", symbol: str = "") -> DataFrame:
    """Pages of an object store's XML listing as catalogue rows; dates come from file names (null without one, the first
    day for months). Pages are parsed where they lie, one at a time."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for page in batch.column(0).to_pylist():
                rows = list(_listed(page or ""))
                yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(("key", "size", "modified"))}, pa.schema([("key", pa.string()), ("size", pa.int64()), ("modified", pa.string())]))

    keys = listings.select(xml_col).mapInArrow(run, "key string, size bigint, modified string")
    return catalog_rows(keys, base_url, data_type, market, frequency, symbol)


def _listed(xml: str):
    if not xml.strip():
        return
    for node in ET.fromstring(xml).iter():
        if node.tag.rpartition("}")[2] == "Contents":
            own = {x.tag.rpartition("}")[2]: x.text for x in node}
            yield own.get("Key"), int(own.get("Size") or 0), own.get("LastModified")


def catalog_rows(keys: DataFrame, base_url: str, data_type: str = "", market: str = "", frequency: str = "", symbol: str = "") -> DataFrame:
    """key, size, modified -> the catalogue's columns."""
    name = F.element_at(F.split("key", "/"), -1)
    found = F.regexp_extract(name, r"(\d{4}-\d{2}(?:-\d{2})?)", 1)
    day = F.when(F.length(found) == 10, F.to_date(found, "yyyy-MM-dd")).when(F.length(found) == 7, F.to_date(F.concat(found, F.lit("-01")), "yyyy-MM-dd"))
    return keys.select(
        name.alias("filename"), day.alias("date"), F.concat(F.lit(base_url.rstrip("/") + "/"), "key").alias("url"), F.col("size").alias("size_bytes"), F.col("modified").alias("last_modified"),
        F.lit(symbol).alias("symbol"), F.lit(data_type).alias("data_type"), F.lit(market).alias("market"), F.lit(frequency).alias("frequency"),
    )


def smart_catalog(catalog: DataFrame, start: str, end: str) -> DataFrame:
    """Of a catalogue of both frequencies, the archives that cover the range once: monthly ones for whole months, daily
    ones for the rest; no checksum files, each name once, in order of date."""
    parts = [
        catalog.filter((F.col("frequency") == kind.value) & F.col("date").between(F.lit(a), F.lit(b)) & F.endswith("filename", F.lit(".zip")))
        for a, b, kind in determine_optimal_frequency(start, end)
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.dropDuplicates(["filename"]).orderBy(F.asc_nulls_last("date"), "filename")


def filter_by_date_range(catalog: DataFrame, start: str, end: str) -> DataFrame:
    return catalog.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def suffix_counts(catalog: DataFrame) -> DataFrame:
    """One row: zips, checksums, first and last date."""
    return catalog.agg(
        F.count_if(F.endswith("filename", F.lit(".zip"))).alias("zips"), F.count_if(F.endswith("filename", F.lit(".CHECKSUM"))).alias("checksums"),
        F.min("date").alias("first"), F.max("date").alias("last"),
    )


def missing_files(catalog: DataFrame, present: DataFrame) -> DataFrame:
    """Catalogue rows without a present file of the same name and size."""
    return catalog.join(present.select("filename", "size_bytes"), ["filename", "size_bytes"], "left_anti").select(*catalog.columns)


def file_urls(spark: SparkSession, repository: ArchiveRepository, config: DataConfig, days: Sequence[date], frequency: Frequency) -> DataFrame:
    rows = [(*repository.file_url(config, frequency, d), d) for d in days]
    return spark.createDataFrame(rows, "url string, filename string, date date")


