import pytest
from pyspark.sql import functions as F

from stratabar.operators.dollarbars import aggregate_trades_to_dollar_bars_fixed
from stratabar.operators.imbalance import aggregate_trades_to_dollar_imbalance_bars, aggregate_trades_to_tick_imbalance_bars
from stratabar.operators.timebars import aggregate_trades_to_ohlcv
from stratabar.streaming.bars import stream_dollar_bars, stream_imbalance_bars, stream_time_bars
from tests.test_bars import make, walk


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Trades of two symbols in three files, each of a later time."""
    folder = str(tmp_path_factory.mktemp("trades"))
    prices, quantity = walk(900, 41)
    trades = make(spark, prices, quantity).withColumn("symbol", F.when(F.col("trade_id") % 3 == 0, "a").otherwise("b"))
    for k in range(3):
        trades.filter((F.col("trade_id") >= 300 * k) & (F.col("trade_id") < 300 * (k + 1))).coalesce(1).write.mode("append").parquet(f"{folder}/all")
    return trades, f"{folder}/all"


def run(spark, path, operator, mode, name):
    stream = spark.readStream.schema("trade_id bigint, time bigint, price double, quantity double, quote_quantity double, is_buyer_maker boolean, symbol string").option("maxFilesPerTrigger", 1).parquet(path)
    query = operator(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_time_bars(spark, parts):
    trades, path = parts
    got = run(spark, path, lambda t: stream_time_bars(t, 60_000, partition_cols=("symbol",)), "complete", "time_bars")
    want = aggregate_trades_to_ohlcv(trades, 60_000, partition_cols=["symbol"])
    key = lambda df: sorted((r["symbol"], r["open_time"], r["open"], r["close"], r["count"], round(r["volume"], 6)) for r in df.collect())
    assert key(got) == key(want)
    final = run(spark, path, lambda t: stream_time_bars(t, 60_000, "10 seconds"), "append", "final_bars")
    assert final.count() and final.exceptAll(aggregate_trades_to_ohlcv(trades, 60_000).select(*final.columns).limit(0)).select("open_time").distinct().count() == final.count()


def test_dollar_bars(spark, parts):
    trades, path = parts
    got = run(spark, path, lambda t: stream_dollar_bars(t, 7000.0), "append", "dollar_bars").filter("closed")
    want = aggregate_trades_to_dollar_bars_fixed(trades, 7000.0, partition_cols=["symbol"])
    key = lambda df: {(r["symbol"], r["bar_id"]): (r["num_trades"], r["open"], r["close"], round(r["quote_volume"], 6)) for r in df.collect()}
    got, want = key(got), key(want)
    assert got.items() <= want.items() and len(want) - len(got) <= 2


@pytest.mark.parametrize("dollars", [False, True])
def test_imbalance_bars(spark, parts, dollars):
    trades, path = parts
    if dollars:
        seed = {s: trades.filter(f"symbol = '{s}'").orderBy("time").first()["quote_quantity"] for s in "ab"}
        trades = trades.filter("symbol = 'a'")
        got = run(spark, path, lambda t: stream_imbalance_bars(t.filter("symbol = 'a'"), 50, 3, 20, seed["a"]), "append", "dollar_imbalance")
        want = aggregate_trades_to_dollar_imbalance_bars(trades, 50, 3, 20, partition_cols=["symbol"])
    else:
        got = run(spark, path, lambda t: stream_imbalance_bars(t, 50, 3, 20), "append", "tick_imbalance")
        want = aggregate_trades_to_tick_imbalance_bars(trades, 50, 3, 20, partition_cols=["symbol"])
    key = lambda df: {(r["symbol"], r["bar_id"]): tuple(round(r[c], 6) for c in ("num_trades", "open_time", "close_time", "open", "high", "low", "close", "volume", "taker_buy_base_volume", "cumulative_theta", "expected_imbalance")) for r in df.collect()}
    closed, want = key(got.filter("closed")), key(want)
    assert closed and closed.items() <= want.items() and len(want) - len(closed) <= 2
