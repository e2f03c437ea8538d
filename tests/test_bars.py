import random
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from stratabar.functions.intervals import TimeInterval
from stratabar.operators import dollarbars, imbalance, stats, timebars, validate
from stratabar.plans.queries import QUERIES, SQL
from stratabar.plans.trades import trades_from_events
from tests import oracle

SF = "/root/testdata/sf0.001"
SCHEMA = "trade_id bigint, time bigint, price double, quantity double, quote_quantity double, is_buyer_maker boolean"


def make(spark, prices, quantity=10.0, step=1000, start=1_700_000_000_000, shuffle=True, symbol=None):
    q = quantity if isinstance(quantity, list) else [quantity] * len(prices)
    rows = [(i, start + i * step, float(p), float(v), float(p) * v, i % 2 == 0) for i, (p, v) in enumerate(zip(prices, q, strict=True))]
    if shuffle:
        random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def walk(n, seed, p=0.55):
    rng, x, prices, quantity = random.Random(seed), 100.0, [], []
    for _ in range(n):
        x = max(1.0, x + rng.choice([0.0, 0.01, 0.05]) * (1 if rng.random() < p else -1))
        prices.append(round(x, 2))
        quantity.append(round(rng.expovariate(0.1) + 0.001, 3))
    return prices, quantity


def test_time_bars_conserve_and_keep_order(spark):
    prices, quantity = walk(500, 3)
    trades = make(spark, prices, quantity)
    bars = timebars.aggregate_trades_to_ohlcv(trades, 7000).orderBy("open_time").collect()
    again = timebars.aggregate_trades_to_ohlcv(trades, 7000, packed_ids=True).orderBy("open_time").collect()
    assert [tuple(map(lambda v: round(v, 6), b)) for b in bars] == [tuple(map(lambda v: round(v, 6), b)) for b in again]
    assert sum(b["count"] for b in bars) == 500 and sum(b["volume"] for b in bars) == pytest.approx(sum(quantity))
    assert bars[0]["open"] == prices[0] and bars[-1]["close"] == prices[-1]
    assert all(b["open_time"] % 7000 == 0 and b["close_time"] == b["open_time"] + 6999 for b in bars)
    assert validate.ohlc_violations(timebars.aggregate_trades_to_ohlcv(trades, 7000)).isEmpty()


def test_time_bars_nulls_ties_and_empty(spark):
    rows = [(2, 1000, 5.0, None, None, None), (1, 1000, 7.0, None, None, False), (3, 2500, None, 1.0, 2.0, False), (4, -500, 1.0, 1.0, 1.0, False)]
    bars = {b["open_time"]: b for b in timebars.aggregate_trades_to_ohlcv(spark.createDataFrame(rows, SCHEMA), 1000).collect()}
    assert (bars[1000]["open"], bars[1000]["close"], bars[1000]["volume"], bars[1000]["taker_buy_volume"]) == (7.0, 5.0, 0.0, 0.0)
    assert bars[2000]["count"] == 0 and bars[-1000]["count"] == 1
    assert timebars.aggregate_trades_to_ohlcv(spark.createDataFrame([], SCHEMA), 1000).count() == 0
    with pytest.raises(ValueError):
        timebars.aggregate_trades_to_ohlcv(spark.createDataFrame([], "time bigint"), 1000)


@pytest.mark.parametrize("threshold", [100.0, 2500.0, 1e9, 0.5])
def test_fixed_dollar_bars(spark, threshold):
    prices, quantity = walk(400, 5)
    quantity[7], quantity[200] = 900.0, 4000.0
    trades = make(spark, prices, quantity)
    got = [r["bar_id"] for r in dollarbars.label_fixed(trades, threshold, bucket_ms=17_000).orderBy("trade_id").collect()]
    assert got == oracle.fixed([p * q for p, q in zip(prices, quantity, strict=True)], threshold)


def test_fixed_dollar_bars_golden(spark):
    rows = [(i, i * 1000, 1.0, Decimal(v), Decimal(v), True) for i, v in enumerate([250, 10, 10, 100, 30])]
    trades = spark.createDataFrame(rows, SCHEMA.replace("quantity double", "quantity decimal(18,2)"))
    assert [r["bar_id"] for r in dollarbars.label_fixed(trades, 100, bucket_ms=2000).orderBy("trade_id").collect()] == [0, 1, 2, 2, 3]
    bars = dollarbars.aggregate_trades_to_dollar_bars_fixed(trades, 100).orderBy("bar_id").collect()
    assert [b["num_trades"] for b in bars] == [1, 1, 2, 1] and bars[2]["bar_dollar_volume"] == 110
    assert dollarbars.aggregate_trades_to_dollar_bars_fixed(trades.limit(0), 100).count() == 0
    with pytest.raises(ValueError):
        dollarbars.aggregate_trades_to_dollar_bars_fixed(trades, 0)


def test_dollar_value_overrides(spark):
    trades = make(spark, [1.0] * 6, 1.0).withColumn("dollar_value", F.lit(50.0))
    bars = dollarbars.aggregate_trades_to_dollar_bars_fixed(trades, 100).orderBy("bar_id").collect()
    assert [(b["num_trades"], b["bar_dollar_volume"], b["quote_volume"]) for b in bars] == [(2, 100.0, 2.0)] * 3


def test_null_partitions(spark):
    trades = make(spark, walk(60, 9)[0]).withColumn("symbol", F.when(F.col("trade_id") % 2 == 0, "a"))
    bars = dollarbars.aggregate_trades_to_dollar_bars_fixed(trades, 5000, partition_cols=["symbol"])
    assert {r["symbol"]: r["n"] for r in bars.groupBy("symbol").agg(F.sum("num_trades").alias("n")).collect()} == {"a": 30, None: 30}


def test_ema_golden(spark):
    volumes = [100, 110, 105, 115, 120, 125, 130, 125, 135, 140]
    daily = spark.createDataFrame([(i * TimeInterval.DAY, float(v)) for i, v in enumerate(volumes)], "day_start bigint, daily_dollar_volume double")
    got = [r["ema_daily_volume"] for r in dollarbars.calculate_ema_daily_volume(daily, 3, 1).orderBy("day_start").collect()]
    assert got == pytest.approx([100.0, 106.666667, 105.714286, 110.666667, 115.483871, 120.31746, 125.19685, 125.098039, 130.058708, 135.034213], abs=1e-6)
    got = [r["ema_daily_volume"] for r in dollarbars.calculate_ema_daily_volume(daily, 3).orderBy("day_start").collect()]
    assert got[:2] == [None, None] and got[2] is not None
    assert dollarbars.calculate_dynamic_threshold(1_000_000, 50) == 20_000
    with pytest.raises(ValueError):
        dollarbars.calculate_dynamic_threshold(1.0, 0)


@pytest.mark.parametrize("initial", [None, 3000.0])
def test_dynamic_dollar_bars(spark, initial):
    prices, quantity = walk(600, 11)
    step = 1_800_000
    trades = make(spark, prices, quantity, step=step)
    bars, thresholds = dollarbars.aggregate_trades_to_dollar_bars_dynamic(trades, 5, ema_span=4, initial_threshold=initial)
    table = {r["day_start"]: r["threshold"] for r in thresholds.collect()}
    times = [1_700_000_000_000 + i * step for i in range(600)]
    days = [t - t % TimeInterval.DAY for t in times]
    first = initial or next(table[d] for d in sorted(table))
    ids, used = oracle.dynamic([p * q for p, q in zip(prices, quantity, strict=True)], days, table, first)
    want = {}
    for i, u in zip(ids, used, strict=True):
        want[i] = (want.get(i, (0,))[0] + 1, u)
    assert {b["bar_id"]: (b["num_trades"], b["threshold_used"]) for b in bars.collect()} == want


@pytest.mark.parametrize(
    "prices,want",
    [
        ([100, 101, 102, 101.5, 101.5, 101.5, 102, 101], [1, 1, 1, -1, -1, -1, 1, -1]),
        ([100, 99.9, 99.8, 99.7, 99.6], [1, -1, -1, -1, -1]),
        ([100, 101, 102, 102, 101, 101, 103], [1, 1, 1, 1, -1, -1, 1]),
    ],
)
def test_tick_rule_golden(spark, prices, want):
    assert [r["sign"] for r in imbalance.calculate_tick_rule(make(spark, prices), bucket_ms=3000).orderBy("trade_id").collect()] == want
    assert oracle.signs(prices) == want


def test_biased_ema_golden():
    for n, window, want in [(2, 2, 1.12), (3, 3, 1.196286), (5, 5, 1.231251), (10, 10, 1.173085), (20, 20, 1.100514), (50, 20, 10.033197), (100, 20, 10.496868), (1000, 20, 10.5)]:
        assert imbalance.biased_ema([1.0] * n, window) == pytest.approx(want, abs=1e-6)
    values = [random.Random(2).random() * 1000 for _ in range(5000)]
    assert imbalance.biased_ema(values, 20) == oracle.strange_mean(values, 20)


def _bars(df):
    return [(b["num_trades"], b["cumulative_theta"], b["expected_imbalance"]) for b in df.orderBy("bar_id").collect()]


@pytest.mark.parametrize("dollars", [False, True])
@pytest.mark.parametrize("case", ["up", "down", "alternating", "constant", "volatile", "walk", "long"])
def test_imbalance_bars(spark, dollars, case):
    up = [100 + 10 * i / 999 for i in range(1000)]
    prices, params = {
        "up": (up, (100, 3, 10)), "down": (up[::-1], (100, 3, 10)), "alternating": ([100.1, 99.9] * 500, (200, 3, 10)), "constant": ([100.0] * 100, (10, 3, 5)),
        "volatile": ([100, 200, 50, 150, 25], (2, 3, 20)), "walk": (walk(1500, 13)[0], (50, 3, 20)), "long": (walk(6000, 17, 0.5)[0], (300, 3, 20)),
    }[case]
    quantity = walk(len(prices), 19)[1] if case in ("walk", "long") else 10.0
    trades = make(spark, prices, quantity)
    f = imbalance.aggregate_trades_to_dollar_imbalance_bars if dollars else imbalance.aggregate_trades_to_tick_imbalance_bars
    quotes = [p * q for p, q in zip(map(float, prices), quantity if isinstance(quantity, list) else [quantity] * len(prices), strict=True)]
    want = oracle.imbalance(prices, quotes, *params, dollars)
    got = _bars(f(trades, *params))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [x for g in got for x in g[1:]] == pytest.approx([x for w in want for x in w[1:]], rel=1e-9)
    if case == "up" and not dollars:
        assert len(got) == 135 and got[-1] == pytest.approx((5, 5.0, 8.0))
    if case == "up" and dollars:
        assert len(got) == 16 and got[0][2] == pytest.approx(1000.0) and got[-1][0] == 381


def test_imbalance_by_symbol_is_each_alone(spark):
    a, b = make(spark, walk(300, 23)[0]), make(spark, walk(300, 29)[0])
    both = a.withColumn("s", F.lit("a")).unionByName(b.withColumn("s", F.lit(None).cast("string")))
    bars = imbalance.aggregate_trades_to_tick_imbalance_bars(both, 20, partition_cols=["s"])
    alone = imbalance.aggregate_trades_to_tick_imbalance_bars(a, 20)
    assert _bars(bars.filter("s = 'a'")) == _bars(alone)
    assert bars.agg(F.sum("num_trades")).first()[0] == 600
    assert imbalance.aggregate_trades_to_tick_imbalance_bars(a.limit(0)).count() == 0


def test_prefix_stability(spark):
    prices = walk(400, 31)[0]
    whole, half = make(spark, prices), make(spark, prices[:200])
    for f in (lambda t: dollarbars.aggregate_trades_to_dollar_bars_fixed(t, 5000), lambda t: imbalance.aggregate_trades_to_tick_imbalance_bars(t, 30)):
        a, b = (f(t).orderBy("bar_id").collect() for t in (whole, half))
        assert [tuple(r) for r in b[:-1]] == [tuple(r) for r in a[: len(b) - 1]]


def test_validation(spark):
    bars = timebars.aggregate_trades_to_ohlcv(trades_from_events(spark, SF), TimeInterval.DAY)
    good = validate.validate_aggregation_accuracy(bars, bars)
    assert good["passed"] and good["unmatched_rows"] == 0 and "PASSED" in validate.format_validation_results(good)
    bad = validate.validate_aggregation_accuracy(bars, bars.withColumn("high", F.col("high") + 1))
    assert not bad["passed"] and bad["differences"].count() == bad["total_rows"]
    shifted = validate.validate_aggregation_accuracy(bars, bars.withColumn("open_time", F.col("open_time") + 1))
    assert not shifted["passed"] and "no times match" in shifted["error"]
    assert not validate.validate_aggregation_accuracy(bars, bars.limit(1))["passed"]
    same = validate.compare_dataframes(bars, bars.withColumn("open_time", F.timestamp_millis("open_time")))
    assert same.status == "PERFECT_MATCH" and same.match_rate == 100.0 and "PERFECT_MATCH" in str(same)
    off = validate.compare_dataframes(bars, bars.withColumn("low", F.col("low") - 1))
    assert off.status == "MISMATCHES_FOUND" and off.mismatches["low"] == off.total_rows and len(off.samples["low"]) == 5
    c = validate.conservation(trades_from_events(spark, SF), bars).first()
    assert c["trades"] == c["bar_trades"] and c["bar_volume"] == pytest.approx(c["trade_volume"])


def test_cumulative_sum_over_buckets(spark):
    prices, quantity = walk(200, 37)
    signed = imbalance.calculate_tick_rule(make(spark, prices, quantity), bucket_ms=5000)
    got = [r["cum_signed"] for r in stats.cumulative_signed_volume(signed, bucket_ms=5000).orderBy("trade_id").collect()]
    total, want = 0.0, []
    for s, p, q in zip(oracle.signs(prices), prices, quantity, strict=True):
        total += s * p * q
        want.append(total)
    assert got == pytest.approx(want)


def test_volatility_of_bars_whose_low_is_zero(spark, tmp_path):
    hours = [[4.0, 5.0], [0.0, 3.0], [0.0, 1.0], [2.0, 2.0], [None]]
    rows = [(i, datetime(2024, 1, 1, h, i), 1, "view", p, '{"k": 1}') for h, prices in enumerate(hours) for i, p in enumerate(prices, 10 * h)]
    want = [1, 2, 0, 3, 4]
    for extra, first in (([], want), ([(99, datetime(2024, 1, 1, 7), 1, "view", 0.0, '{"k": 1}')], [7, *want])):
        d = f"{tmp_path}/{len(extra)}"
        spark.createDataFrame(rows + extra, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
        got = [tuple(r) for r in QUERIES["volatility_top1"](spark, d).collect()]
        assert repr(got) == repr(con.execute(SQL["volatility_top1"]).fetchall())
        bars = timebars.aggregate_trades_to_ohlcv(trades_from_events(spark, d), TimeInterval.HOUR)
        ranked = stats.most_volatile(bars, 9).collect()
        assert [r["open_time"] // TimeInterval.HOUR % 24 for r in ranked] == first
        assert [str(r["volatility"]) for r in ranked] == ["nan"] * len(extra) + ["inf", "inf", "25.0", "0.0", "None"]
