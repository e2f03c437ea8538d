import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from stratabar.functions.intervals import STANDARD_INTERVALS, bin_start, parse_interval
from stratabar.functions.timestamps import TimestampFormat, detect_timestamp_format, fix_timestamp_display, normalize_timestamp_to_datetime, restore_original_timestamp_format
from stratabar.operators.resample import OHLCVAggregator, aggregate_ohlcv, detect_source_interval
from stratabar.schemas import DataType, Frequency, Market, get_data_config, get_data_type_schema
from stratabar.sources import catalog, ingest

T0 = 1_700_000_000_000
CANDLE = "open_time bigint, open double, high double, low double, close double, volume double, close_time bigint, quote_asset_volume double, number_of_trades bigint, other string, ignore bigint"


def candles(spark, n=130, step=60_000):
    start = T0 - T0 % 3_600_000
    rows = [(start + i * step, float(i), i + 2.0, i - 2.0, i + 1.0, 1.0, start + i * step + step - 1, 2.0, 3, "x", 0) for i in range(n)]
    return spark.createDataFrame(rows[::-1], CANDLE)


def test_intervals(spark):
    assert len(STANDARD_INTERVALS) == 18 and STANDARD_INTERVALS["1w"] == 604800 and parse_interval("15m") == 900
    with pytest.raises(ValueError):
        parse_interval("7m")
    got = spark.createDataFrame([(-5,), (5,), (10,)], "t bigint").select(bin_start("t", 10)).collect()
    assert [r[0] for r in got] == [-10, 0, 10]


def test_formats(spark):
    t = spark.createDataFrame([(T0 + i,) for i in range(5)], "open_time bigint")
    kinds = {
        TimestampFormat.UNIX_MILLISECONDS: F.col("open_time"), TimestampFormat.UNIX_SECONDS: F.floor(F.col("open_time") / 1000), TimestampFormat.UNIX_MICROSECONDS: F.col("open_time") * 1000,
        TimestampFormat.DATETIME_US: F.timestamp_millis("open_time"), TimestampFormat.DATETIME_US_QUIRK: F.timestamp_micros("open_time"),
    }
    for fmt, c in kinds.items():
        own = t.select(c.alias("open_time"))
        assert detect_timestamp_format(own) is fmt
        normal, found = normalize_timestamp_to_datetime(own)
        assert found is fmt and normal.schema["open_time"].dataType.typeName() == "timestamp"
        assert [r[0] for r in restore_original_timestamp_format(normal, "open_time", fmt).collect()] == [r[0] for r in own.collect()]
    assert detect_timestamp_format(t.select(F.col("open_time").cast("double").alias("open_time"))) is TimestampFormat.UNIX_MILLISECONDS
    with pytest.raises(TypeError):
        detect_timestamp_format(t.select(F.col("open_time").cast("string").alias("open_time")))
    with pytest.raises(TypeError):
        fix_timestamp_display(t)
    fixed = fix_timestamp_display(t.select(F.timestamp_micros("open_time").alias("open_time")))
    assert fixed.select(F.unix_millis("open_time")).first()[0] == T0


def test_resample(spark):
    df = candles(spark)
    assert detect_source_interval(df) == 60
    hours = aggregate_ohlcv(df, "1h").orderBy("open_time").collect()
    assert [h["volume"] for h in hours] == [60.0, 60.0, 10.0] and hours[0]["open"] == 0.0 and hours[0]["close"] == 60.0 and hours[2]["high"] == 131.0
    assert aggregate_ohlcv(df, "1h").columns == ["open_time", "close_time", "open", "high", "low", "close", "volume", "quote_asset_volume", "number_of_trades", "ignore"]
    many = aggregate_ohlcv(df, {"a": 120, "b": 3600}, source_interval="1m", output_format="s")
    assert many["a"].count() == 65 and many["b"].agg(F.min("open_time")).first()[0] == (T0 - T0 % 3_600_000) // 1000
    assert set(aggregate_ohlcv(df, ["5m", 900])) == {"5m", "900s"}
    one = OHLCVAggregator(60).aggregate_all(df, {"a": 120, "b": 3600})
    assert {r["interval"]: r["count"] for r in one.groupBy("interval").count().collect()} == {"a": 65, "b": 3}
    for bad in (90, 30):
        with pytest.raises(ValueError):
            aggregate_ohlcv(df, bad)
    with pytest.raises(ValueError):
        aggregate_ohlcv(df.limit(0), "1h")
    with pytest.raises(ValueError):
        aggregate_ohlcv(df, "1h", output_format="weeks")
    named = df.withColumnRenamed("volume", "vol")
    assert OHLCVAggregator(60, column_mapping={"volume": "vol"}).aggregate(named, 3600).agg(F.sum("volume")).first()[0] == 130.0
    stamped = aggregate_ohlcv(df.withColumns({c: F.timestamp_millis(c) for c in ("open_time", "close_time")}), "1h")
    assert stamped.schema["open_time"].dataType.typeName() == "timestamp" and stamped.count() == 3


def test_schemas():
    assert get_data_type_schema(DataType.TRADES).names == ["trade_id", "price", "quantity", "quote_quantity", "time", "is_buyer_maker"]
    with pytest.raises(ValueError):
        get_data_type_schema(DataType.LIQUIDATION_SNAPSHOT)
    assert get_data_config("klines_v1")["timestamp_cols"] == ["open_time", "close_time"] and get_data_config("klines")["timestamp_cols"] == []
    with pytest.raises(ValueError):
        get_data_config("metrics")


def test_plan():
    plan = catalog.determine_optimal_frequency("2024-05-03", "2024-11-20")
    assert plan == [
        (date(2024, 5, 3), date(2024, 5, 31), Frequency.DAILY), (date(2024, 6, 1), date(2024, 10, 31), Frequency.MONTHLY), (date(2024, 11, 1), date(2024, 11, 20), Frequency.DAILY),
    ]
    assert catalog.determine_optimal_frequency("2024-02-01", "2024-02-29") == [(date(2024, 2, 1), date(2024, 2, 29), Frequency.MONTHLY)]
    with pytest.raises(ValueError):
        catalog.determine_optimal_frequency("2024-02-02", "2024-02-01")


def test_requests(spark):
    with pytest.raises(ValueError):
        catalog.DataConfig("BTC", DataType.KLINES)
    config = catalog.DataConfig("BTC", DataType.KLINES, Market.USD_M, interval="1m")
    repo = catalog.ArchiveRepository("https://archive.example/")
    assert repo.file_url(config, Frequency.MONTHLY, date(2024, 5, 1)) == ("https://archive.example/data/futures/um/monthly/klines/BTC/1m/BTC-1m-2024-05.zip", "BTC-1m-2024-05.zip")
    with pytest.raises(ValueError):
        repo.validate_config(catalog.DataConfig("BTC", DataType.METRICS, Market.SPOT))
    assert catalog.get_data_frequency(DataType.METRICS) is Frequency.DAILY and catalog.get_file_extension(DataType.TRADES) == "zip"
    page = "<r xmlns='urn:x'><Contents><Key>a/B-2024-05.zip</Key><Size>7</Size><LastModified>m</LastModified></Contents><Contents><Key>a/none.zip</Key><Size>1</Size></Contents></r>"
    rows = catalog.parse_listings(spark.createDataFrame([(page,), (None,)], "xml string"), "https://archive.example").orderBy("filename").collect()
    assert [(r["filename"], r["date"], r["size_bytes"]) for r in rows] == [("B-2024-05.zip", date(2024, 5, 1), 7), ("none.zip", None, 1)]


def _zip(path, text):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("notes.txt", "no")
        z.writestr("data.csv", text)


def test_archives(spark, tmp_path):
    _zip(tmp_path / "a.zip", "id,price,qty,quote_qty,time,is_buyer_maker\n1,2.5,2,5,1700000000000,true\n2,bad,1,,1700000001000,False\n")
    _zip(tmp_path / "b.zip", "3,1,1,1,1700000002000,True\n\n4,1,1,1,1700000003000,False\n")
    got = {r["trade_id"]: r for r in ingest.read_archives(spark, f"{tmp_path}/*.zip", DataType.TRADES).collect()}
    assert sorted(got) == [1, 2, 3, 4] and got[1]["quote_quantity"] == 5.0 and got[1]["is_buyer_maker"] and got[2]["price"] is None and got[2]["quote_quantity"] is None
    assert not ingest.has_header("True,1") and ingest.has_header("open_time,open") and not ingest.has_header("2024-01-01 00:00:00,BTC")
    stamped = ingest.read_archives(spark, f"{tmp_path}/b.zip", DataType.TRADES, timestamps=True)
    assert stamped.agg(F.min(F.unix_millis("time"))).first()[0] == 1700000002000
    out = ingest.ingest_archives(spark, f"{tmp_path}/*.zip", DataType.TRADES, "BTC", f"{tmp_path}/lake")
    assert out.filter("symbol = 'BTC' AND year_month = '2023_11'").count() == 4
    (tmp_path / "plain.csv").write_text("qty,id,price,quote_qty,time,is_buyer_maker\n2,9,2.5,5,1700000000000,true\n")
    r = ingest.read_csv(spark, f"{tmp_path}/plain.csv", DataType.TRADES).first()
    assert (r["trade_id"], r["quantity"]) == (9, 2.0)
    assert ingest.output_path("/x", "BTC", DataType.TRADES, "2024-05-03", "s") == "/x/dataset_BTC/2024_05/trades/s.parquet"


def test_compaction_keeps_inputs(spark, tmp_path):
    for k in (2, 0, 1):
        spark.range(k * 10, k * 10 + 10).select(F.col("id").alias("trade_id"), (F.col("id") * 7 % 30).alias("time")).write.parquet(f"{tmp_path}/d{k}")
    files = [f"{tmp_path}/d{k}" for k in range(3)]
    out = ingest.compact(spark, files, f"{tmp_path}/month", DataType.TRADES)
    assert out.count() == 30 and spark.read.parquet(*files).count() == 30
