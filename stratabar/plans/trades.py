"""The events table as trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trades_from_rows(events: DataFrame, exact: bool = False) -> DataFrame:
    """trade_id, time, price, quantity, quote_quantity, is_buyer_maker, symbol. exact: prices as decimals of two places,
    so sums don't depend on their order."""
    k = F.get_json_object("props", "$.k").cast("int") + 1
    price = F.col("value").cast("decimal(18,2)") if exact else F.col("value")
    quantity = k.cast("decimal(10,0)") if exact else k.cast("double")
    return events.select(
        F.col("event_id").alias("trade_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), price.alias("price"), quantity.alias("quantity"),
        (price * quantity).alias("quote_quantity"), (F.col("event_id") % 2 == 0).alias("is_buyer_maker"), F.col("event_type").alias("symbol"),
    )


def trades_from_events(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    return trades_from_rows(spark.read.parquet(f"{sf_dir}/events.parquet"), exact)


#: The same in SQL.
TRADES_SQL = """trades AS (
  SELECT event_id AS trade_id, epoch_us(ts) // 1000 AS time, value AS price, CAST(CAST(json_extract(props, '$.k') AS INT) + 1 AS DOUBLE) AS quantity,
         value * (CAST(json_extract(props, '$.k') AS INT) + 1) AS quote_quantity, event_id % 2 = 0 AS is_buyer_maker, event_type AS symbol
  FROM events
)"""
EXACT_SQL = """trades AS (
  SELECT event_id AS trade_id, epoch_us(ts) // 1000 AS time, CAST(value AS DECIMAL(18,2)) AS price, CAST(CAST(json_extract(props, '$.k') AS INT) + 1 AS DECIMAL(10,0)) AS quantity,
         CAST(value AS DECIMAL(18,2)) * CAST(CAST(json_extract(props, '$.k') AS INT) + 1 AS DECIMAL(10,0)) AS quote_quantity, event_id % 2 = 0 AS is_buyer_maker, event_type AS symbol
  FROM events
)"""
