"""From a folder of archives to one table of a type, in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratabar.schemas import TIME_COLUMNS, DataType
from stratabar.sources.catalog import catalog_rows, filter_by_date_range
from stratabar.sources.ingest import present_sources, read_archives, write_parquet


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue of the ZIP files of a folder; only names and sizes are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    return catalog_rows(files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").cast("string").alias("modified")), "").withColumn("url", F.expr("ltrim('/', url)"))


def ingest_range(spark: SparkSession, folder: str, data_type: DataType, symbol: str, start: str, end: str, out: str) -> dict[str, int]:
    """Adds to `out`, partitioned by symbol, month and type, the archives of a folder whose names bear dates from start
    to end and that aren't there yet, told by source_file. Rows are in time order inside each file. Returns how many
    archives were wanted and how many were new; run again, it adds nothing."""
    wanted = filter_by_date_range(list_archives(spark, folder), start, end).select("url")
    new = wanted.join(present_sources(spark, out).withColumnRenamed("source_file", "url"), "url", "left_anti")
    n, files = wanted.count(), [r["url"] for r in new.collect()]  # a row per archive
    if files:
        time = F.col(TIME_COLUMNS[data_type])
        at = F.to_timestamp(time) if dict(read_archives(spark, files, data_type).dtypes)[TIME_COLUMNS[data_type]] == "string" else F.timestamp_millis(time)
        rows = read_archives(spark, files, data_type).withColumns({"symbol": F.lit(symbol), "year_month": F.date_format(at, "yyyy_MM"), "data_type": F.lit(data_type.value)})
        write_parquet(rows.repartition("year_month", F.col("source_file")).sortWithinPartitions("year_month", TIME_COLUMNS[data_type]), out, ["symbol", "year_month", "data_type"], mode="append")
    return {"wanted": n, "new": len(files)}
