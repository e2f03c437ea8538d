"""One query per operator over the events table, and the SQL that gives the same rows.

Doubles are rounded on both sides, for sums of doubles depend on their order in the last digits.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stratabar.functions.intervals import TimeInterval
from stratabar.functions.timestamps import TimestampFormat, detect_timestamp_format, fix_timestamp_display, normalize_timestamp_to_datetime, restore_original_timestamp_format
from stratabar.operators import dollarbars, imbalance, resample, stats, timebars, validate
from stratabar.plans.trades import EXACT_SQL, TRADES_SQL, trades_from_events, trades_from_rows
from stratabar.schemas import DataType, Frequency, to_candle_names
from stratabar.sources import catalog, ingest
from stratabar.sources.pipeline import ingest_range
from stratabar.streaming.bars import stream_dollar_bars, stream_imbalance_bars, stream_time_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name).cast("double"), digits).alias(f.name) if isinstance(f.dataType, DoubleType) or f.dataType.typeName() == "decimal" else F.col(f.name) for f in df.schema])


# ---- time bars

_SUMS = """round(sum(quantity), 6) AS volume, round(sum(quote_quantity), 6) AS quote_volume, count(price) AS count,
  round(sum(CASE WHEN is_buyer_maker THEN 0 ELSE quantity END), 6) AS taker_buy_volume, round(sum(CASE WHEN is_buyer_maker THEN 0 ELSE quote_quantity END), 6) AS taker_buy_quote_volume"""
_OHLC = "round(arg_min(price, (time, trade_id)), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, (time, trade_id)), 6) AS close"


def _bin(interval: int, t: str = "time") -> str:
    return f"({t} - (({t} % {interval}) + {interval}) % {interval})"


def ohlcv_sql(interval: int, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""WITH {TRADES_SQL}
SELECT {keys}{_bin(interval)} AS open_time, {_OHLC}, {_SUMS}, {_bin(interval)} + {interval} - 1 AS close_time, 0 AS ignore FROM trades GROUP BY ALL"""


def _add_time_bars() -> None:
    for name, ms in {"1s": 1000, "1m": 60_000, "15m": 900_000, "1h": 3_600_000, "1d": 86_400_000, "1w": 604_800_000}.items():
        query(ohlcv_sql(ms), f"ohlcv_{name}")(lambda spark, d, ms=ms: rounded(timebars.aggregate_trades_to_ohlcv(trades_from_events(spark, d), ms, packed_ids=True)))


_add_time_bars()


@query(ohlcv_sql(3_600_000, "symbol"))
def ohlcv_1h_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    return rounded(timebars.aggregate_trades_to_ohlcv(trades_from_events(spark, d), TimeInterval.HOUR, partition_cols=["symbol"], packed_ids=True))


def _file(spark: SparkSession, name: str) -> str:
    """A place in the folder that all executors share. A temporary folder stands in only where Spark is one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or mkdtemp(prefix='stratabar-')}/{name}-{uuid.uuid4().hex}"


@query(ohlcv_sql(900_000))
def ohlcv_from_file(spark: SparkSession, d: str) -> DataFrame:
    path = _file(spark, "trades")
    trades_from_events(spark, d).write.parquet(path)
    return rounded(timebars.aggregate_trades_from_file(spark, path, 15 * TimeInterval.MINUTE, f"{path}-bars", packed_ids=True))


@query(ohlcv_sql(3_600_000))
def stream_ohlcv_1h(spark: SparkSession, d: str) -> DataFrame:
    """The streaming operator, run over all that is there."""
    return rounded(_streamed(spark, d, lambda t: stream_time_bars(t, TimeInterval.HOUR), "complete"))


def _streamed(spark: SparkSession, d: str, operator: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    out = _file(spark, "stream")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    run = operator(trades_from_rows(events)).writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").foreachBatch(write).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out)


# ---- resampling and time units


def _candles_sql(interval: int) -> str:
    return f"""candles AS (SELECT {_bin(interval)} AS open_time, {_bin(interval)} + {interval} - 1 AS close_time, arg_min(price, (time, trade_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (time, trade_id)) AS close, sum(quantity) AS volume, sum(quote_quantity) AS quote_asset_volume, count(price) AS number_of_trades,
  sum(CASE WHEN is_buyer_maker THEN 0 ELSE quantity END) AS taker_buy_base_asset_volume, sum(CASE WHEN is_buyer_maker THEN 0 ELSE quote_quantity END) AS taker_buy_quote_asset_volume FROM trades GROUP BY ALL)"""


def _resampled_sql(target: int, extra: str = "") -> str:
    return f"""SELECT {extra}min(open_time) AS open_time, max(close_time) AS close_time, round(arg_min(open, open_time), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low,
  round(arg_max(close, open_time), 6) AS close, round(sum(volume), 6) AS volume, round(sum(quote_asset_volume), 6) AS quote_asset_volume, CAST(sum(number_of_trades) AS BIGINT) AS number_of_trades,
  round(sum(taker_buy_base_asset_volume), 6) AS taker_buy_base_asset_volume, round(sum(taker_buy_quote_asset_volume), 6) AS taker_buy_quote_asset_volume, 0 AS ignore
  FROM candles GROUP BY {_bin(target, 'open_time')}"""


def candles(spark: SparkSession, d: str, interval_ms: int) -> DataFrame:
    return to_candle_names(timebars.aggregate_trades_to_ohlcv(trades_from_events(spark, d), interval_ms, packed_ids=True))


@query(f"WITH {TRADES_SQL}, {_candles_sql(3_600_000)} {_resampled_sql(14_400_000)}")
def resample_1h_to_4h(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.aggregate_ohlcv(candles(spark, d, TimeInterval.HOUR), "4h", source_interval="1h", timestamp_format="unix_milliseconds"))


_MULTI = {"2h": 7_200_000, "12h": 43_200_000, "1d": 86_400_000}


@query(f"WITH {TRADES_SQL}, {_candles_sql(3_600_000)} " + " UNION ALL ".join(_resampled_sql(ms, f"'{k}' AS interval, ") for k, ms in _MULTI.items()))
def resample_multi(spark: SparkSession, d: str) -> DataFrame:
    targets = {k: ms // 1000 for k, ms in _MULTI.items()}
    return rounded(resample.OHLCVAggregator(3600, timestamp_format="unix_milliseconds").aggregate_all(candles(spark, d, TimeInterval.HOUR), targets))


@query(f"WITH {TRADES_SQL}, {_candles_sql(3_600_000)} SELECT make_timestamp(open_time * 1000) AS open_time, close FROM (SELECT min(open_time) AS open_time, round(arg_max(close, open_time), 6) AS close FROM candles GROUP BY {_bin(86_400_000, 'open_time')})")
def resample_datetime_output(spark: SparkSession, d: str) -> DataFrame:
    out = resample.aggregate_ohlcv(candles(spark, d, TimeInterval.HOUR), ["1d"], source_interval="1h", timestamp_format="unix_milliseconds", output_format="datetime")["1d"]
    return rounded(out.select(F.col("open_time").cast("timestamp_ntz").alias("open_time"), "close"))


@query(
    f"""WITH {TRADES_SQL}, b AS (SELECT DISTINCT {_bin(3_600_000)} AS t FROM trades), f AS (SELECT t FROM b ORDER BY t LIMIT {resample.SAMPLE + 1}),
s AS (SELECT (t - lag(t) OVER (ORDER BY t)) // 1000 AS step FROM f) SELECT step AS seconds FROM s WHERE step IS NOT NULL GROUP BY step ORDER BY count(*) DESC, step LIMIT 1"""
)
def detect_interval(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.lit(resample.detect_source_interval(candles(spark, d, TimeInterval.HOUR))).cast("bigint").alias("seconds"))


@query(f"WITH {TRADES_SQL} SELECT trade_id, time * 1000 AS open_time, time * 1000 AS close_time FROM trades")
def ts_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Microseconds to timestamps and back: digits below the millisecond go."""
    t = trades_from_events(spark, d).select("trade_id", (F.col("time") * 1000 + 7).alias("open_time"), (F.col("time") * 1000 + 999).alias("close_time"))
    normal, fmt = normalize_timestamp_to_datetime(t, "open_time", TimestampFormat.UNIX_MICROSECONDS)
    return restore_original_timestamp_format(normal, "open_time", fmt)


@query(f"WITH {TRADES_SQL} SELECT trade_id, make_timestamp(time * 1000) AS open_time FROM trades")
def fix_ts_display(spark: SparkSession, d: str) -> DataFrame:
    t = trades_from_events(spark, d).select("trade_id", F.timestamp_micros("time").alias("open_time"))
    return fix_timestamp_display(t).withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))


# ---- dollar bars

_DAILY = f"daily AS (SELECT {_bin(86_400_000)} AS day_start, CAST(sum(quote_quantity) AS DOUBLE) AS v FROM trades GROUP BY ALL), numbered AS (SELECT *, row_number() OVER (ORDER BY day_start) AS n FROM daily)"


def _ema_sql(span: int, least: str) -> str:
    q = 1 - 2 / (span + 1)
    weighed = f"SELECT a.day_start, a.n, a.v, sum(b.v * power({q!r}, a.n - b.n)) AS num, sum(power({q!r}, a.n - b.n)) AS den FROM numbered a JOIN numbered b ON b.n <= a.n GROUP BY a.day_start, a.n, a.v"
    return f"ema AS (SELECT day_start, n, v, CASE WHEN n >= {least} THEN num / den END AS e FROM ({weighed}))"


@query(f"WITH {EXACT_SQL}, {_DAILY} SELECT day_start, round(v, 6) AS daily_dollar_volume FROM daily")
def daily_dollar_volume(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dollarbars.calculate_daily_dollar_volume(trades_from_events(spark, d, exact=True)))


@query(f"WITH {EXACT_SQL}, {_DAILY}, {_ema_sql(5, '3')} SELECT day_start, round(v, 6) AS daily_dollar_volume, round(e, 4) AS ema_daily_volume FROM ema")
def ema_daily_volume(spark: SparkSession, d: str) -> DataFrame:
    daily = dollarbars.calculate_daily_dollar_volume(trades_from_events(spark, d, exact=True))
    return rounded(dollarbars.calculate_ema_daily_volume(daily, 5, 3)).withColumn("ema_daily_volume", F.round("ema_daily_volume", 4))


@query(
    f"""WITH {EXACT_SQL}, {_DAILY}, {_ema_sql(20, 'least(20, (SELECT count(*) FROM daily))')}
SELECT day_start, round(coalesce(e / 50, (SELECT e / 50 FROM ema WHERE e IS NOT NULL ORDER BY n LIMIT 1)), 4) AS threshold, round(e, 4) AS ema_daily_volume FROM ema"""
)
def dynamic_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dollarbars.dynamic_thresholds(trades_from_events(spark, d, exact=True), 50), 4)


_TAKER = """
  round(CAST(sum(CASE WHEN is_buyer_maker THEN 0 ELSE quantity END) AS DOUBLE), 6) AS taker_buy_base_volume, round(CAST(sum(CASE WHEN is_buyer_maker THEN 0 ELSE quote_quantity END) AS DOUBLE), 6) AS taker_buy_quote_volume,"""
_BAR = f"""min(time) AS open_time, max(time) AS close_time, round(CAST(arg_min(price, (time, trade_id)) AS DOUBLE), 6) AS open, round(CAST(max(price) AS DOUBLE), 6) AS high, round(CAST(min(price) AS DOUBLE), 6) AS low,
  round(CAST(arg_max(price, (time, trade_id)) AS DOUBLE), 6) AS close, round(CAST(sum(quantity) AS DOUBLE), 6) AS volume, round(CAST(sum(quote_quantity) AS DOUBLE), 6) AS quote_volume,{_TAKER}
  count(*) AS num_trades"""


def fixed_bars_sql(threshold: int, by: str = "", select: str | None = None) -> str:
    """The bars trade by trade: an independent check of the closed form."""
    part, same = (f"PARTITION BY {by} ", f"AND t.{by} = r.{by} ") if by else ("", "")
    key, rkey = (f"{by}, ", f"t.{by}, ") if by else ("", "")
    return f"""WITH RECURSIVE {EXACT_SQL}, t AS MATERIALIZED (SELECT *, row_number() OVER ({part}ORDER BY time, trade_id) AS i FROM trades),
r AS (
  SELECT {key}i, trade_id, CAST(0 AS BIGINT) AS bar_id, CAST(quote_quantity AS DECIMAL(38,2)) AS c FROM t WHERE i = 1
  UNION ALL
  SELECT {rkey}t.i, t.trade_id, CASE WHEN r.c >= {threshold} THEN r.bar_id + 1 ELSE r.bar_id END,
         CAST(t.quote_quantity + CASE WHEN r.c >= {threshold} THEN r.c - {threshold} ELSE r.c END AS DECIMAL(38,2))
  FROM r JOIN t ON t.i = r.i + 1 {same}
)
{select or f"SELECT {key}bar_id, {_BAR}, round(CAST(sum(quote_quantity) AS DOUBLE), 6) AS bar_dollar_volume FROM r JOIN trades USING (trade_id{', ' + by if by else ''}) GROUP BY {key}bar_id"}"""


@query(fixed_bars_sql(100_000))
def dollar_bars_fixed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dollarbars.aggregate_trades_to_dollar_bars_fixed(trades_from_events(spark, d, exact=True), 100_000))


@query(fixed_bars_sql(5_000))
def dollar_bars_fixed_small(spark: SparkSession, d: str) -> DataFrame:
    """A threshold below single trades: one close per trade at most."""
    return rounded(dollarbars.aggregate_trades_to_dollar_bars_fixed(trades_from_events(spark, d, exact=True), 5_000))


@query(fixed_bars_sql(50_000, "symbol"))
def dollar_bars_fixed_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    return rounded(dollarbars.aggregate_trades_to_dollar_bars_fixed(trades_from_events(spark, d, exact=True), 50_000, partition_cols=["symbol"]))


_DYNAMIC = f"""WITH RECURSIVE {TRADES_SQL}, {_DAILY}, {_ema_sql(20, 'least(20, (SELECT count(*) FROM daily))')},
th AS (SELECT day_start, coalesce(e / 50, (SELECT e / 50 FROM ema WHERE e IS NOT NULL ORDER BY n LIMIT 1)) AS th FROM ema),
t AS MATERIALIZED (SELECT trades.*, day_start, th, row_number() OVER (ORDER BY time, trade_id) AS i FROM trades JOIN th ON th.day_start = {_bin(86_400_000)}),
r AS (
  SELECT i, trade_id, day_start, (SELECT e / 50 FROM ema WHERE e IS NOT NULL ORDER BY n LIMIT 1) AS used, CAST(0 AS BIGINT) AS bar_id, quote_quantity AS c FROM t WHERE i = 1
  UNION ALL
  SELECT t.i, t.trade_id, t.day_start, CASE WHEN t.day_start <> r.day_start THEN t.th ELSE r.used END, CASE WHEN r.c >= r.used THEN r.bar_id + 1 ELSE r.bar_id END,
         t.quote_quantity + CASE WHEN r.c >= r.used THEN r.c - r.used ELSE r.c END
  FROM r JOIN t ON t.i = r.i + 1
)"""


@query(f"{_DYNAMIC} SELECT bar_id, {_BAR}, round(sum(quote_quantity), 6) AS bar_dollar_volume, round(arg_max(used, i), 4) AS threshold_used FROM r JOIN trades USING (trade_id) GROUP BY bar_id")
def dollar_bars_dynamic(spark: SparkSession, d: str) -> DataFrame:
    bars, _ = dollarbars.aggregate_trades_to_dollar_bars_dynamic(trades_from_events(spark, d), 50)
    return rounded(bars).withColumn("threshold_used", F.round("threshold_used", 4))


@query(
    fixed_bars_sql(
        100_000, "symbol",
        f"SELECT symbol, bar_id, {_BAR.replace(_TAKER, '')}, round(CAST(sum(quote_quantity) AS DOUBLE), 6) AS bar_dollar_volume, max(c) >= 100000 AS closed FROM r JOIN trades USING (trade_id, symbol) GROUP BY symbol, bar_id",
    )
)
def stream_dollar_bars_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_streamed(spark, d, lambda t: stream_dollar_bars(t, 100_000.0), "append"))


# ---- imbalance bars and signs

_SIGNS = """s AS (SELECT *, CASE WHEN price > lag(price) OVER o THEN 1 WHEN price < lag(price) OVER o THEN -1 END AS ch FROM trades WINDOW o AS (ORDER BY time, trade_id)),
signed AS (SELECT *, CAST(coalesce(last_value(ch IGNORE NULLS) OVER (ORDER BY time, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS INT) AS sign FROM s)"""


@query(f"WITH {EXACT_SQL}, {_SIGNS} SELECT trade_id, sign FROM signed")
def tick_rule(spark: SparkSession, d: str) -> DataFrame:
    return imbalance.calculate_tick_rule(trades_from_events(spark, d, exact=True)).select("trade_id", F.col("sign").cast("int").alias("sign"))


@query(f"WITH {EXACT_SQL}, {_SIGNS} SELECT count(*) FILTER (sign = 1) AS ups, count(*) FILTER (sign = -1) AS downs, CAST(sum(sign) AS BIGINT) AS net, round(count(*) FILTER (sign = 1) / count(*), 6) AS up_share FROM signed")
def tick_distribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.tick_distribution(imbalance.calculate_tick_rule(trades_from_events(spark, d, exact=True))))


_CUM = "cum AS (SELECT trade_id, CAST(sum(sign * quote_quantity) OVER (ORDER BY time, trade_id) AS DOUBLE) AS cum_signed FROM signed)"


@query(f"WITH {EXACT_SQL}, {_SIGNS}, {_CUM} SELECT trade_id, round(cum_signed, 6) AS cum_signed FROM cum")
def cum_signed_volume(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.cumulative_signed_volume(imbalance.calculate_tick_rule(trades_from_events(spark, d, exact=True))).select("trade_id", "cum_signed"))


@query(
    f"WITH {EXACT_SQL}, {_SIGNS}, {_CUM} "
    + " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, count(*) FILTER (abs(cum_signed) >= {t}) AS exceedances FROM cum" for t in (10_000, 100_000, 1_000_000))
)
def threshold_exceedances(spark: SparkSession, d: str) -> DataFrame:
    cum = stats.cumulative_signed_volume(imbalance.calculate_tick_rule(trades_from_events(spark, d, exact=True)))
    return stats.threshold_exceedances(cum, (10_000, 100_000, 1_000_000))


def _mean_sql(values: str, n: str, window: str) -> str:
    """The mean that imbalance bars are defined by, as a sum: value i (from 0) weighs q^(n - 1 - i), divided by what each of
    the steps max(i, 1) to window - 1 is divided by."""
    q = f"(1 - 2.0 / ({window} + 1))"
    w = f"((1 - power({q}, k + 1)) / (1 - {q}))"
    steps = f"list_aggregate(list_transform(range(greatest(i, 1), least({window}, {n})), lambda k: 1 + {q} * {w} / ({w} + 1)), 'product')"
    return f"list_sum(list_transform(range({n}), lambda i: {values}[i + 1] * power({q}, {n} - 1 - i) / coalesce({steps}, 1.0)))"


def imbalance_bars_sql(init: int, dollars: bool = False, by: str = "", closed: str = "") -> str:
    """Bar after bar instead of trade after trade: each step looks for the first trade at which the running imbalance has
    moved by the threshold since the bar before. Thresholds follow from the lengths of the last 20 bars and, over three
    times the expected length, the share of rises (and the quote quantities)."""
    g = by or "''"
    v = "quote_quantity" if dollars else "1"
    value = "CASE WHEN n > 1000 THEN list_avg(ql[1:1000]) ELSE ql[1] END" if dollars else "1.0"
    new_value = f"CASE WHEN e > 10 THEN {_mean_sql('last', 'm', 'least(20, m)')} ELSE value END" if dollars else "1.0"
    find = lambda b, th: f"coalesce(list_position(list_transform(cl[{b} + 1:], lambda x: abs(x - CASE WHEN {b} = 0 THEN 0 ELSE cl[{b}] END) >= {th}), true) + {b}, 0)"
    signs = _SIGNS.replace("(ORDER BY", "(PARTITION BY g ORDER BY")
    return f"""WITH RECURSIVE {TRADES_SQL.replace('trades AS (', 'own AS (', 1)}, trades AS (SELECT *, {g} AS g FROM own), {signs},
places AS (SELECT *, row_number() OVER w AS i, sum(sign * {v}) OVER w AS c, count(*) FILTER (sign = 1) OVER w AS u FROM signed WINDOW w AS (PARTITION BY g ORDER BY time, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lists AS MATERIALIZED (SELECT g, CAST(count(*) AS BIGINT) AS n, list(CAST(c AS DOUBLE) ORDER BY i) AS cl, list(u ORDER BY i) AS ul, list(CAST(quote_quantity AS DOUBLE) ORDER BY i) AS ql FROM places GROUP BY g),
bars AS (
  SELECT g, CAST(0 AS BIGINT) AS bar_id, CAST(0 AS BIGINT) AS b, th, CAST({init} AS DOUBLE) AS ticks, CAST(0.01 AS DOUBLE) AS factor, value, CAST([] AS BIGINT[]) AS lens, CAST({find('0', 'th')} AS BIGINT) AS e, th AS reported
  FROM (SELECT *, CAST({init} AS DOUBLE) * 0.01 * value AS th FROM (SELECT *, CAST({value} AS DOUBLE) AS value FROM lists))
  UNION ALL
  SELECT g, bar_id + 1, e, th2, ticks2, factor2, value2, lens2, CAST({find('e', 'th2')} AS BIGINT), th
  FROM (SELECT *, ticks2 * factor2 * value2 AS th2 FROM (SELECT *, CAST({new_value} AS DOUBLE) AS value2, CASE WHEN e > 10 THEN greatest(abs(2 * least(0.9, greatest(0.1, (ul[e] - CASE WHEN e = m THEN 0 ELSE ul[e - m] END) / m)) - 1), 0.01) ELSE factor END AS factor2
    FROM (SELECT *, ql[e - m + 1:e] AS last FROM (SELECT *, CAST(greatest(10, least(floor(3 * ticks2), e)) AS BIGINT) AS m
      FROM (SELECT *, CASE WHEN len(lens2) > 1 THEN greatest({_mean_sql('lens2', 'len(lens2)', 'len(lens2)')}, 0.1 * {init}) ELSE ticks END AS ticks2
        FROM (SELECT bars.*, n, cl, ul, ql, list_append(lens, e - b)[-20:] AS lens2 FROM bars JOIN lists USING (g) WHERE e > 0 AND e < n))))))
),
spans AS (SELECT bars.g, bar_id, b, CASE WHEN e = 0 THEN n ELSE e END AS z, e > 0 AS closed, CASE WHEN e = 0 THEN reported ELSE th END AS expected FROM bars JOIN lists USING (g)),
labelled AS (SELECT places.*, bar_id, closed, expected, b FROM places JOIN spans ON spans.g = places.g AND i > b AND i <= z)
SELECT {f'{by}, ' if by else ''}bar_id, min(time) AS open_time, max(time) AS close_time, round(arg_min(price, i), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, i), 6) AS close,
  round(sum(quantity), 6) AS volume, round(sum(quote_quantity), 6) AS quote_volume, round(sum(CASE WHEN sign = 1 THEN quantity ELSE 0 END), 6) AS taker_buy_base_volume,
  round(sum(CASE WHEN sign = 1 THEN quote_quantity ELSE 0 END), 6) AS taker_buy_quote_volume, count(*) AS num_trades, round(CAST(sum(sign * {v}) AS DOUBLE), 6) AS cumulative_theta, round(max(expected), 6) AS expected_imbalance{closed}
FROM labelled GROUP BY {f'{by}, ' if by else ''}bar_id"""


@query(imbalance_bars_sql(1000))
def tick_imbalance_bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(imbalance.aggregate_trades_to_tick_imbalance_bars(trades_from_events(spark, d), 1000))


@query(imbalance_bars_sql(200, by="symbol"))
def tick_imbalance_bars_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    return rounded(imbalance.aggregate_trades_to_tick_imbalance_bars(trades_from_events(spark, d), 200, partition_cols=["symbol"]))


@query(imbalance_bars_sql(1000, dollars=True))
def dollar_imbalance_bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(imbalance.aggregate_trades_to_dollar_imbalance_bars(trades_from_events(spark, d), 1000))


@query(imbalance_bars_sql(300, dollars=True, by="symbol"))
def dollar_imbalance_bars_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    return rounded(imbalance.aggregate_trades_to_dollar_imbalance_bars(trades_from_events(spark, d), 300, partition_cols=["symbol"]))


@query(imbalance_bars_sql(200, by="symbol", closed=", bool_or(closed) AS closed"))
def stream_tick_imbalance_bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_streamed(spark, d, lambda t: stream_imbalance_bars(t, 200), "append"))


# ---- checks and statistics


def _perturbed(bars: DataFrame) -> DataFrame:
    """The bars with every seventh hour's close a little off."""
    return bars.withColumn("close", F.when((F.col("open_time") / TimeInterval.HOUR).cast("bigint") % 7 == 0, F.col("close") + 0.5).otherwise(F.col("close")))


_HOURLY = f"hourly AS (SELECT {_bin(3_600_000)} AS open_time, arg_max(price, (time, trade_id)) AS close, max(price) AS high FROM trades GROUP BY ALL)"


@query(
    f"""WITH {TRADES_SQL}, {_HOURLY}, g AS (SELECT CASE WHEN (open_time // 3600000) % 7 = 0 THEN abs(close - (close + 0.5)) ELSE 0 END AS gap FROM hourly)
SELECT 'close' AS measure, round(max(gap), 6) AS max_diff, round(avg(gap), 6) AS mean_diff, count(*) FILTER (gap > 1e-6) AS mismatches, max(gap) <= 1e-6 AS within FROM g
UNION ALL SELECT 'high', 0.0, 0.0, 0, true"""
)
def validate_accuracy(spark: SparkSession, d: str) -> DataFrame:
    bars = timebars.aggregate_trades_to_ohlcv(trades_from_events(spark, d), TimeInterval.HOUR, packed_ids=True)
    return rounded(validate.difference_metrics(validate.differences(bars, _perturbed(bars), "open_time", ("close", "high")), ("close", "high"), 1e-6))


@query(f"WITH {TRADES_SQL}, {_HOURLY} SELECT open_time, round(close, 6) AS close, round(close + 0.5, 6) AS close_other FROM hourly WHERE (open_time // 3600000) % 7 = 0")
def compare_frames(spark: SparkSession, d: str) -> DataFrame:
    bars = timebars.aggregate_trades_to_ohlcv(trades_from_events(spark, d), TimeInterval.HOUR, packed_ids=True)
    return rounded(validate.differing_rows(validate.differences(bars, _perturbed(bars), "open_time", ("close",)), ("close",), 1e-6))


@query(f"WITH {TRADES_SQL} SELECT round(sum(quantity), 6) AS trade_volume, round(sum(quote_quantity), 4) AS trade_quote_volume, count(price) AS trades, min(price) AS least_price, max(price) AS greatest_price, round(sum(quantity), 6) AS bar_volume, round(sum(quote_quantity), 4) AS bar_quote_volume, count(price) AS bar_trades, min(price) AS least_low, max(price) AS greatest_high FROM trades")
def volume_conservation(spark: SparkSession, d: str) -> DataFrame:
    trades = trades_from_events(spark, d)
    return rounded(validate.conservation(trades, timebars.aggregate_trades_to_ohlcv(trades, TimeInterval.HOUR, packed_ids=True)), 4)


@query(
    f"""WITH {TRADES_SQL}, b AS (SELECT arg_min(price, (time, trade_id)) AS o, max(price) AS h, min(price) AS l, arg_max(price, (time, trade_id)) AS c FROM trades GROUP BY {_bin(900_000)})
SELECT count(*) FILTER (h < o OR h < c OR l > o OR l > c) AS violations, count(*) AS bars, round(sum(h - l), 4) AS spans FROM b"""
)
def ohlc_integrity(spark: SparkSession, d: str) -> DataFrame:
    bars = timebars.aggregate_trades_to_ohlcv(trades_from_events(spark, d), 15 * TimeInterval.MINUTE, packed_ids=True)
    broken = validate.ohlc_violations(bars).select("open_time", F.lit(1).alias("broken"))
    return rounded(bars.join(broken, "open_time", "left").agg(F.count("broken").alias("violations"), F.count(F.lit(1)).alias("bars"), F.sum(F.col("high") - F.col("low")).alias("spans")), 4)


@query(f"WITH {TRADES_SQL}, l AS (SELECT time, lag(time) OVER (ORDER BY trade_id) AS b FROM trades) SELECT count(*) FILTER (time < b) AS out_of_order FROM l")
def is_sorted(spark: SparkSession, d: str) -> DataFrame:
    return validate.out_of_order(trades_from_events(spark, d), "time", "trade_id")


@query(f"WITH {TRADES_SQL} SELECT count(DISTINCT {_bin(3_600_000)}) AS bars, true AS finer_than_target, abs(count(DISTINCT {_bin(3_600_000)}) - (max({_bin(3_600_000)}) - min({_bin(3_600_000)}) + 3600000) / 3600000) < 2 AS complete FROM trades")
def row_count_check(spark: SparkSession, d: str) -> DataFrame:
    bars = timebars.aggregate_trades_to_ohlcv(trades_from_events(spark, d), TimeInterval.HOUR, packed_ids=True)
    span = bars.agg(F.min("open_time").alias("a"), F.max("open_time").alias("b"), F.count(F.lit(1)).alias("n")).first()
    complete = validate.validate_row_counts(bars, 60, 3600, (span["b"] - span["a"] + TimeInterval.HOUR) / 1000)
    return spark.range(1).select(F.lit(span["n"]).cast("bigint").alias("bars"), F.lit(validate.validate_row_counts(bars, 60, 3600)).alias("finer_than_target"), F.lit(complete).alias("complete"))


@query(f"WITH {TRADES_SQL}, b AS (SELECT {_bin(3_600_000)} AS open_time, max(price) AS high, min(price) AS low FROM trades GROUP BY ALL) SELECT open_time, round((high - low) / low * 100, 4) AS volatility FROM b ORDER BY (high - low) / low * 100 DESC, open_time LIMIT 1")
def volatility_top1(spark: SparkSession, d: str) -> DataFrame:
    bars = timebars.aggregate_trades_to_ohlcv(trades_from_events(spark, d), TimeInterval.HOUR, packed_ids=True)
    return rounded(stats.most_volatile(bars).select("open_time", "volatility"), 4)


@query(f"WITH {TRADES_SQL}, b AS (SELECT {_bin(3_600_000)} AS t, sum(quantity) AS v, count(*) AS n, sum(CASE WHEN is_buyer_maker THEN 0 ELSE quantity END) AS tv FROM trades GROUP BY ALL) SELECT round(sum(tv) / sum(v), 4) AS taker_share, round(avg(v), 4) AS avg_volume, round(max(v), 4) AS max_volume, round(avg(n), 4) AS avg_trades, max(n) AS max_trades FROM b")
def taker_ratio(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.taker_ratio(timebars.aggregate_trades_to_ohlcv(trades_from_events(spark, d), TimeInterval.HOUR, packed_ids=True)), 4)


@query(f"WITH {TRADES_SQL} SELECT count(quote_quantity) AS n, count(*) FILTER (quote_quantity IS NULL) AS nulls, round(sum(quote_quantity), 4) AS total, round(avg(quote_quantity), 4) AS mean, round(stddev_samp(quote_quantity), 4) AS std, round(min(quote_quantity), 4) AS least, round(median(quote_quantity), 4) AS median, round(max(quote_quantity), 4) AS greatest FROM trades")
def describe_quote(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.describe(trades_from_events(spark, d), "quote_quantity"), 4)


@query(f"WITH {TRADES_SQL} SELECT round(stddev_samp(quote_quantity) / avg(quote_quantity), 6) AS cv FROM trades")
def coef_variation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.coefficient_of_variation(trades_from_events(spark, d), "quote_quantity"))


_STATS = "count(*) AS bars, round(avg(n), 4) AS avg_trades, round(avg((z - a) / 1000), 4) AS avg_seconds, round(stddev_samp((z - a) / 1000) / avg((z - a) / 1000), 4) AS cv_seconds"


@query(
    fixed_bars_sql(
        100_000,
        select=f""", time_bars AS (SELECT {_bin(900_000)} AS a, {_bin(900_000)} + 899999 AS z, count(*) AS n FROM trades GROUP BY ALL),
dollar AS (SELECT min(time) AS a, max(time) AS z, count(*) AS n FROM r JOIN trades USING (trade_id) GROUP BY bar_id)
SELECT 'time' AS kind, {_STATS} FROM time_bars UNION ALL SELECT 'dollar', {_STATS} FROM dollar""",
    )
)
def bar_comparison(spark: SparkSession, d: str) -> DataFrame:
    trades = trades_from_events(spark, d, exact=True)
    bars = {"time": timebars.aggregate_trades_to_ohlcv(trades, 15 * TimeInterval.MINUTE, packed_ids=True), "dollar": dollarbars.aggregate_trades_to_dollar_bars_fixed(trades, 100_000)}
    return rounded(stats.compare_bars(bars, {"time": "count"}), 4)


@query(f"WITH {TRADES_SQL} SELECT DISTINCT symbol FROM trades")
def distinct_symbols(spark: SparkSession, d: str) -> DataFrame:
    return trades_from_events(spark, d).select("symbol").distinct().orderBy("symbol")


@query(f"WITH {TRADES_SQL} SELECT trade_id, time, round(price, 6) AS price FROM trades ORDER BY time, trade_id LIMIT 500")
def first_trades(spark: SparkSession, d: str) -> DataFrame:
    """A read capped to the first rows in time order."""
    return rounded(trades_from_events(spark, d).orderBy("time", "trade_id").limit(500).select("trade_id", "time", "price"))


# ---- archives and catalogue


@query(f"WITH {TRADES_SQL} SELECT trade_id, round(price, 6) AS price, round(quantity, 6) AS quantity, round(quote_quantity, 4) AS quote_quantity, time, is_buyer_maker FROM trades")
def ingest_zip(spark: SparkSession, d: str) -> DataFrame:
    """Trades written as zipped CSV files, with and without a header, and read back by the archive reader."""
    folder, trades = _file(spark, "zip"), trades_from_events(spark, d).select("trade_id", "price", "quantity", "quote_quantity", "time", "is_buyer_maker")
    named = trades.withColumnsRenamed({"trade_id": "id", "quantity": "qty", "quote_quantity": "quote_qty"})
    ingest.export_archives(named.filter("id % 2 = 0").repartition(2), folder, "named")
    ingest.export_archives(named.filter("id % 2 = 1").repartition(2), folder, "bare", header=False)
    out = ingest.read_archives(spark, f"{folder}/*.zip", DataType.TRADES).drop("source_file")
    return rounded(out).withColumn("quote_quantity", F.round("quote_quantity", 4))


@query(f"WITH {TRADES_SQL} SELECT trade_id, time FROM trades")
def compact_daily(spark: SparkSession, d: str) -> DataFrame:
    folder = _file(spark, "daily")
    trades_from_events(spark, d).select("trade_id", "time", (F.col("time") / TimeInterval.DAY).cast("int").alias("day")).write.partitionBy("day").parquet(folder)
    days = spark.read.parquet(folder)
    files = sorted({f for f in days.inputFiles()})
    return ingest.compact(spark, files, f"{folder}-whole", DataType.TRADES).select("trade_id", "time")


_LISTED = """listed AS (SELECT o_orderkey % 400 AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'monthly' ELSE 'daily' END AS frequency FROM orders),
days AS (SELECT DISTINCT k, frequency, CASE WHEN frequency = 'monthly' THEN date_trunc('month', DATE '2024-01-15' + CAST(k AS INT)) ELSE DATE '2024-01-15' + CAST(k AS INT) END AS date FROM listed),
cat AS (SELECT 'SYM-trades-' || CASE WHEN frequency = 'monthly' THEN strftime(date, '%Y-%m') ELSE strftime(date, '%Y-%m-%d') END || CASE WHEN k % 5 = 0 THEN '.zip.CHECKSUM' ELSE '.zip' END AS filename, CAST(date AS DATE) AS date, k * 10 AS size_bytes, frequency FROM days)"""


def _listing(spark: SparkSession, d: str) -> DataFrame:
    """A made-up listing: dates, sizes and checksum files after the orders' keys."""
    k = F.col("o_orderkey") % 400
    rows = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("k"), F.when(F.col("o_orderkey") % 3 == 0, "monthly").otherwise("daily").alias("frequency")).distinct()
    day = F.date_add(F.lit("2024-01-15").cast("date"), F.col("k").cast("int"))
    stamp = F.when(F.col("frequency") == "monthly", F.date_format(day, "yyyy-MM")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    name = F.concat(F.lit("SYM-trades-"), stamp, F.when(F.col("k") % 5 == 0, ".zip.CHECKSUM").otherwise(".zip"))
    keys = rows.select(F.concat(F.lit("data/"), "frequency", F.lit("/"), name).alias("key"), (F.col("k") * 10).alias("size"), F.lit("").alias("modified"))
    return catalog.catalog_rows(keys, "https://archive.example").withColumn("frequency", F.element_at(F.split("url", "/"), -2))


@query(
    f"""WITH {_LISTED}, chosen AS (SELECT filename, date FROM cat WHERE ends_with(filename, '.zip') AND ((frequency = 'daily' AND (date BETWEEN DATE '2024-05-03' AND DATE '2024-05-31' OR date BETWEEN DATE '2024-11-01' AND DATE '2024-11-20'))
  OR (frequency = 'monthly' AND date BETWEEN DATE '2024-06-01' AND DATE '2024-10-31'))) SELECT DISTINCT filename, date FROM chosen"""
)
def catalog_smart(spark: SparkSession, d: str) -> DataFrame:
    return catalog.smart_catalog(_listing(spark, d), "2024-05-03", "2024-11-20").select("filename", "date")


@query(f"WITH {_LISTED} SELECT filename, size_bytes FROM cat WHERE NOT (size_bytes % 3 = 0)")
def catalog_missing(spark: SparkSession, d: str) -> DataFrame:
    whole = _listing(spark, d)
    return catalog.missing_files(whole, whole.filter("size_bytes % 3 = 0")).select("filename", "size_bytes")


@query(f"WITH {_LISTED} SELECT count(*) FILTER (ends_with(filename, '.zip')) AS zips, count(*) FILTER (ends_with(filename, '.CHECKSUM')) AS checksums, min(date) AS first, max(date) AS last FROM cat WHERE date BETWEEN DATE '2024-03-01' AND DATE '2024-12-31'")
def catalog_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.suffix_counts(catalog.filter_by_date_range(_listing(spark, d), "2024-03-01", "2024-12-31"))


@query("SELECT CAST(x AS DATE) AS date FROM generate_series(TIMESTAMP '2024-02-10', TIMESTAMP '2024-04-05', INTERVAL 1 DAY) AS t(x)")
def date_list(spark: SparkSession, d: str) -> DataFrame:
    return catalog.date_list(spark, "2024-02-10", "2024-04-05")


@query("SELECT CAST(x AS DATE) AS date FROM generate_series(TIMESTAMP '2024-02-01', TIMESTAMP '2024-07-05', INTERVAL 1 MONTH) AS t(x)")
def date_list_monthly(spark: SparkSession, d: str) -> DataFrame:
    return catalog.date_list(spark, "2024-02-10", "2024-07-05", Frequency.MONTHLY)


@query("SELECT * FROM (VALUES (DATE '2024-05-03', DATE '2024-05-31', 'daily'), (DATE '2024-06-01', DATE '2024-10-31', 'monthly'), (DATE '2024-11-01', DATE '2024-11-20', 'daily')) AS t(\"start\", \"end\", frequency)")
def frequency_plan(spark: SparkSession, d: str) -> DataFrame:
    return catalog.frequency_plan(spark, "2024-05-03", "2024-11-20")


@query(f"WITH {TRADES_SQL}, n AS (SELECT count(DISTINCT {_bin(86_400_000)}) AS n FROM trades) SELECT n + 1 AS total, n AS successful, CAST(1 AS BIGINT) AS failed, (SELECT count(*) FROM trades) AS n_rows FROM n")
def process_archives(spark: SparkSession, d: str) -> DataFrame:
    """The trades' archives, one a day, and a broken one, processed twice: the second time adds nothing."""
    folder, out = _file(spark, "zip"), _file(spark, "lake")
    ingest.export_archives(_archived(spark, d), folder, "SYM-trades", by="day")
    fs, path = ingest.shared_file_system(folder)
    with fs.open_output_stream(f"{path}/broken.zip") as f:
        f.write(b"no archive")
    for _ in range(2):
        got = ingest.process_downloaded_files(spark, f"{folder}/*.zip", DataType.TRADES, "SYM", out)
    return spark.read.parquet(out).agg(*[F.lit(v).cast("bigint").alias(k) for k, v in got.items()], F.count(F.lit(1)).alias("n_rows"))


def _archived(spark: SparkSession, d: str) -> DataFrame:
    """Trades with the columns of their archives, and the day."""
    trades = trades_from_events(spark, d).select("trade_id", "price", "quantity", "quote_quantity", "time", "is_buyer_maker")
    return trades.withColumn("day", F.date_format(F.timestamp_millis("time"), "yyyy-MM-dd"))


_ARCHIVED = "trade_id, round(price, 6) AS price, round(quantity, 6) AS quantity, round(quote_quantity, 4) AS quote_quantity, time, is_buyer_maker"


def _as_archived(df: DataFrame) -> DataFrame:
    return rounded(df.select("trade_id", "price", "quantity", "quote_quantity", "time", "is_buyer_maker")).withColumn("quote_quantity", F.round("quote_quantity", 4))


@query(f"WITH {TRADES_SQL} SELECT {_ARCHIVED} FROM trades")
def ingest_csv_mixed(spark: SparkSession, d: str) -> DataFrame:
    """A folder of CSV files with headers of two layouts and without any: each file's first line tells."""
    folder, trades = _file(spark, "csv"), _archived(spark, d).drop("day")
    named = trades.withColumnsRenamed({"trade_id": "id", "quantity": "qty", "quote_quantity": "quote_qty"})
    named.filter("id % 3 = 0").repartition(3).write.csv(f"{folder}/kind=named", header=True)
    named.filter("id % 3 = 1").select("time", "is_buyer_maker", "id", "quote_qty", "qty", "price").write.csv(f"{folder}/kind=turned", header=True)
    trades.filter("trade_id % 3 = 2").repartition(2).write.csv(f"{folder}/kind=bare")
    return _as_archived(ingest.read_csv(spark, [f"{folder}/kind={k}" for k in ("named", "turned", "bare")], DataType.TRADES))


@query(f"WITH {TRADES_SQL} SELECT {_ARCHIVED} FROM trades")
def csv_to_parquet(spark: SparkSession, d: str) -> DataFrame:
    folder = _file(spark, "csv")
    _archived(spark, d).drop("day").write.csv(folder, header=True)
    return _as_archived(ingest.process_csv_to_parquet(spark, folder, f"{folder}-parquet", DataType.TRADES))


@query(f"WITH {TRADES_SQL} SELECT {_ARCHIVED} FROM trades")
def zip_to_parquet(spark: SparkSession, d: str) -> DataFrame:
    folder = _file(spark, "zip")
    ingest.export_archives(_archived(spark, d), folder, "SYM-trades", by="day")
    return _as_archived(ingest.process_zip_to_parquet(spark, f"{folder}/*.zip", f"{folder}-parquet", DataType.TRADES))


@query(f"WITH {TRADES_SQL} SELECT trade_id, make_timestamp(time * 1000) AS time FROM trades")
def archive_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Archives read with their times as timestamps."""
    folder = _file(spark, "zip")
    ingest.export_archives(_archived(spark, d), folder, "SYM-trades", by="day")
    return ingest.read_archives(spark, f"{folder}/*.zip", DataType.TRADES, timestamps=True).select("trade_id", F.col("time").cast("timestamp_ntz").alias("time"))


@query(f"WITH {TRADES_SQL} SELECT trade_id, round(price, 6) AS price, time, is_buyer_maker FROM trades")
def ingest_csv(spark: SparkSession, d: str) -> DataFrame:
    """Trades as CSV files without a header, typed on reading."""
    folder = _file(spark, "csv")
    trades_from_events(spark, d).select("trade_id", "price", "quantity", "quote_quantity", "time", "is_buyer_maker").write.csv(folder)
    return rounded(ingest.read_csv(spark, folder, DataType.TRADES).select("trade_id", "price", "time", "is_buyer_maker"))


@query(f"WITH {TRADES_SQL} SELECT strftime(make_timestamp(time * 1000), '%Y_%m') AS year_month, symbol, count(*) AS n FROM trades GROUP BY ALL")
def partitioned_lake(spark: SparkSession, d: str) -> DataFrame:
    """Trades by symbol and month, read back with the partitions as columns."""
    folder = _file(spark, "lake")
    rows = trades_from_events(spark, d).withColumn("year_month", F.date_format(F.timestamp_millis("time"), "yyyy_MM"))
    ingest.write_parquet(rows, folder, ["symbol", "year_month"], level=3)
    return spark.read.parquet(folder).groupBy(F.col("year_month").cast("string").alias("year_month"), "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'SYM-1m-' || strftime(x, '%Y-%m-%d') || '.zip' AS filename, 'https://archive.example/data/futures/um/daily/klines/SYM/1m/SYM-1m-' || strftime(x, '%Y-%m-%d') || '.zip' AS url
FROM generate_series(TIMESTAMP '2024-02-27', TIMESTAMP '2024-03-02', INTERVAL 1 DAY) AS t(x)""")
def file_urls(spark: SparkSession, d: str) -> DataFrame:
    config = catalog.DataConfig("SYM", DataType.KLINES, interval="1m")
    days = [r["date"] for r in catalog.date_list(spark, "2024-02-27", "2024-03-02").collect()]  # a row per day asked for
    return catalog.file_urls(spark, catalog.ArchiveRepository("https://archive.example"), config, days, Frequency.DAILY).select("filename", "url")


@query("SELECT 'a-2024-05-03.zip' AS filename, DATE '2024-05-03' AS date, CAST(5 AS BIGINT) AS size_bytes UNION ALL SELECT 'a-2024-06.zip', DATE '2024-06-01', 6 UNION ALL SELECT 'a.zip', NULL, 7")
def parse_listing(spark: SparkSession, d: str) -> DataFrame:
    """Two pages of an object store's listing."""
    page = "<L xmlns='http://example/'>{}</L>".format
    item = "<Contents><Key>data/{}</Key><Size>{}</Size><LastModified>now</LastModified></Contents>".format
    pages = [(page(item("a-2024-05-03.zip", 5) + item("a-2024-06.zip", 6)),), (page(item("a.zip", 7)),)]
    return catalog.parse_listings(spark.createDataFrame(pages, "xml string"), "https://archive.example").select("filename", "date", "size_bytes")


@query(f"WITH {TRADES_SQL} SELECT count(*) AS n, count(DISTINCT symbol) AS symbols FROM (SELECT * FROM trades WHERE symbol = 'click' UNION ALL SELECT * FROM trades WHERE symbol <> 'click')")
def concat_parts(spark: SparkSession, d: str) -> DataFrame:
    t = trades_from_events(spark, d)
    return t.filter("symbol = 'click'").unionByName(t.filter("symbol <> 'click'")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("symbols"))


@query(f"WITH {TRADES_SQL} SELECT trade_id, symbol FROM trades")
def shuffled_sample(spark: SparkSession, d: str) -> DataFrame:
    return stats.sample_shuffled(trades_from_events(spark, d).select("trade_id", "symbol"), "trade_id")


@query(f"WITH {TRADES_SQL} SELECT trade_id, time, strftime(make_timestamp(time * 1000), '%Y_%m') AS year_month, 'SYM' AS symbol FROM trades")
def archive_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """All trades as archives, one a day; asked for in two ranges that overlap, and again."""
    folder, out, trades = _file(spark, "zip"), _file(spark, "lake"), _archived(spark, d)
    ingest.export_archives(trades, folder, "SYM-trades", by="day")
    span = trades.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    for start in (span["b"], span["a"], span["a"]):
        ingest_range(spark, folder, DataType.TRADES, "SYM", start, span["b"], out)
    return spark.read.parquet(out).select("trade_id", "time", F.col("year_month").cast("string").alias("year_month"), "symbol")


# ---- public functions and default paths


@query(ohlcv_sql(3_600_000))
def ohlcv_1h_any_ids(spark: SparkSession, d: str) -> DataFrame:
    """The default path, which promises nothing about trade ids."""
    return rounded(timebars.aggregate_trades_to_ohlcv(trades_from_events(spark, d), TimeInterval.HOUR))


@query(
    f"""WITH {TRADES_SQL}, {_HOURLY}, g AS (SELECT (open_time // 3600000) % 7 = 0 AS off, abs(close - (close + 0.5)) AS gap FROM hourly)
SELECT count(*) FILTER (off) = 0 AS passed, count(*) AS total_rows, count(*) AS matched_rows, CAST(0 AS BIGINT) AS unmatched_rows, count(*) FILTER (off) AS differing, round(max(CASE WHEN off THEN gap ELSE 0 END), 6) AS close_max,
  round(avg(CASE WHEN off THEN gap ELSE 0 END), 6) AS close_mean, CAST(9 AS BIGINT) AS measures FROM g"""
)
def validate_bars(spark: SparkSession, d: str) -> DataFrame:
    """The whole of the accuracy validation, as its caller gets it."""
    bars = timebars.aggregate_trades_to_ohlcv(trades_from_events(spark, d), TimeInterval.HOUR, packed_ids=True)
    got = validate.validate_aggregation_accuracy(bars, _perturbed(bars))
    own = {k: got[k] for k in ("passed", "total_rows", "matched_rows", "unmatched_rows")} | {"differing": got["differences"].count(), "close_max": got["metrics"]["close"]["max_diff"], "close_mean": got["metrics"]["close"]["mean_diff"], "measures": len(got["metrics"])}
    return rounded(spark.createDataFrame([tuple(own.values())], "passed boolean, total_rows bigint, matched_rows bigint, unmatched_rows bigint, differing bigint, close_max double, close_mean double, measures bigint"))


@query(
    f"""WITH {TRADES_SQL}, {_HOURLY}, g AS (SELECT (open_time // 3600000) % 7 = 0 AS off FROM hourly)
SELECT count(*) AS total_rows, count(*) AS matched_rows, CAST(100 AS DOUBLE) AS match_rate, CASE WHEN count(*) FILTER (off) > 0 THEN 'MISMATCHES_FOUND' ELSE 'PERFECT_MATCH' END AS status,
  count(*) FILTER (off) AS close_mismatches, CAST(0 AS BIGINT) AS high_mismatches, least(5, count(*) FILTER (off)) AS samples FROM g"""
)
def compare_units(spark: SparkSession, d: str) -> DataFrame:
    """Candles in milliseconds against candles in microseconds."""
    bars = candles(spark, d, TimeInterval.HOUR)
    got = validate.compare_dataframes(bars, _perturbed(bars).withColumn("open_time", F.col("open_time") * 1000))
    own = (got.total_rows, got.matched_rows, got.match_rate, got.status, got.mismatches["close"], got.mismatches["high"], len(got.samples.get("close", [])))
    return spark.createDataFrame([own], "total_rows bigint, matched_rows bigint, match_rate double, status string, close_mismatches bigint, high_mismatches bigint, samples bigint")


@query(
    f"""WITH {TRADES_SQL}, p AS (SELECT round(price, 4) AS price FROM trades) SELECT 'count' AS measure, CAST(count(price) AS DOUBLE) AS price FROM p UNION ALL SELECT 'mean', round(avg(price), 4) FROM p
UNION ALL SELECT 'stddev', round(stddev_samp(price), 4) FROM p UNION ALL SELECT 'min', min(price) FROM p UNION ALL SELECT 'max', max(price) FROM p"""
)
def summary_price(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles are left out here: Spark's are of a sketch."""
    got = stats.summary(rounded(trades_from_events(spark, d).select("price"), 4), "price").filter("summary NOT LIKE '%\\%'")
    return got.select(F.col("summary").alias("measure"), F.round(F.col("price").cast("double"), 4).alias("price"))


@query(f"WITH {TRADES_SQL} SELECT trade_id, time FROM trades ORDER BY time DESC, trade_id DESC LIMIT 300")
def last_trades(spark: SparkSession, d: str) -> DataFrame:
    return stats.row_slice(trades_from_events(spark, d).select("trade_id", "time"), ("time", "trade_id"), -300)


@query(f"WITH {TRADES_SQL} SELECT trade_id, time FROM trades ORDER BY time, trade_id LIMIT 200 OFFSET 100")
def sliced_trades(spark: SparkSession, d: str) -> DataFrame:
    return stats.row_slice(trades_from_events(spark, d).select("trade_id", "time"), ("time", "trade_id"), 100, 200)


@query(f"WITH {TRADES_SQL}, c AS (SELECT *, rank() OVER (ORDER BY price) AS low, count(*) OVER (PARTITION BY price) AS n FROM trades) SELECT trade_id, low + (n - 1) / 2 AS rank FROM c")
def ranked_prices(spark: SparkSession, d: str) -> DataFrame:
    return stats.average_rank(trades_from_events(spark, d).select("trade_id", "price"), "price").select("trade_id", "rank")


@query(f"WITH {TRADES_SQL} SELECT trade_id, CAST(time AS VARCHAR) AS kept, time AS cast FROM trades")
def strict_cast(spark: SparkSession, d: str) -> DataFrame:
    """A column of numbers is cast as a whole; one that holds something else stays as it is."""
    text = trades_from_events(spark, d).select("trade_id", F.col("time").cast("string").alias("cast"), F.col("time").cast("string").alias("kept"))
    mixed = text.withColumn("kept", F.when(F.col("trade_id") == text.agg(F.min("trade_id")).first()[0], F.concat("kept", F.lit("x"))).otherwise(F.col("kept")))
    return stats.cast_or_keep(stats.cast_or_keep(mixed, "cast", "bigint"), "kept", "bigint").withColumn("kept", F.rtrim("kept", F.lit("x")))


@query(
    f"""WITH {TRADES_SQL}, t AS (SELECT min(time) AS t FROM trades), u AS (SELECT 's' AS unit, t // 1000 AS x FROM t UNION ALL SELECT 'ms', t FROM t UNION ALL SELECT 'us', t * 1000 FROM t)
SELECT unit, CASE len(CAST(x AS VARCHAR)) WHEN 10 THEN 'unix_seconds' WHEN 13 THEN 'unix_milliseconds' WHEN 16 THEN 'unix_microseconds' END AS format FROM u
UNION ALL SELECT 'timestamp', CASE WHEN year(make_timestamp(t * 1000)) > 1971 THEN 'datetime_us' END FROM t UNION ALL SELECT 'quirk', CASE WHEN year(make_timestamp(t)) < 1971 THEN 'datetime_us_quirk' END FROM t"""
)
def detect_ts_format(spark: SparkSession, d: str) -> DataFrame:
    t = trades_from_events(spark, d).select("time")
    kinds = {"s": F.floor(F.col("time") / 1000), "ms": F.col("time"), "us": F.col("time") * 1000, "timestamp": F.timestamp_millis("time"), "quirk": F.timestamp_micros("time")}
    found = [(k, detect_timestamp_format(t.select(c.alias("open_time"))).value) for k, c in kinds.items()]
    return spark.createDataFrame(found, "unit string, format string")


@query(ohlcv_sql(3_600_000))
def ohlcv_1h_trusted_order(spark: SparkSession, d: str) -> DataFrame:
    """Trades that arrive in no order, though the caller says they needn't be sorted: the same bars."""
    trades = trades_from_events(spark, d).orderBy(F.xxhash64("trade_id"))
    return rounded(timebars.aggregate_trades_to_ohlcv(trades, TimeInterval.HOUR, ensure_sorted=False))


@query(f"WITH {TRADES_SQL}, t AS (SELECT unnest(['trade_id', 'time', 'price', 'quantity', 'quote_quantity', 'is_buyer_maker', 'symbol']) AS dropped) SELECT dropped, dropped NOT IN ('trade_id', 'symbol') AS refused FROM t")
def required_columns(spark: SparkSession, d: str) -> DataFrame:
    """Which columns time bars can't do without. Only schemas are looked at."""
    trades = trades_from_events(spark, d)

    def refused(dropped: str) -> bool:
        try:
            timebars.aggregate_trades_to_ohlcv(trades.drop(dropped), TimeInterval.HOUR)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(c, refused(c)) for c in trades.columns], "dropped string, refused boolean")


_TARGETS = (1800, 3600, 5400, 7200, 86400)


@query(
    f"""WITH {TRADES_SQL}, {_candles_sql(3_600_000)}, g AS (SELECT open_time - lag(open_time) OVER (ORDER BY open_time) AS gap FROM candles), s AS (SELECT min(gap) // 1000 AS source FROM g),
t AS (SELECT CAST(unnest({list(_TARGETS)}) AS BIGINT) AS target)
SELECT target, target >= source AND target % source = 0 AS allowed FROM t, s"""
)
def allowed_targets(spark: SparkSession, d: str) -> DataFrame:
    """To which intervals, in seconds, hourly candles can be resampled, told from the candles themselves."""
    bars = candles(spark, d, TimeInterval.HOUR)
    source = resample.detect_source_interval(bars)

    def allowed(target: int) -> bool:
        try:
            resample.aggregate_ohlcv(bars, target, source_interval=source, timestamp_format="unix_milliseconds")
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(t, allowed(t)) for t in _TARGETS], "target bigint, allowed boolean")


@query(
    f"""WITH {TRADES_SQL}, {_candles_sql(3_600_000)}, r AS ({_resampled_sql(14_400_000)})
SELECT 'unix_microseconds' AS named, open_time * 1000 AS open_time, close FROM r UNION ALL SELECT 'unix_seconds', open_time // 1000, close FROM r"""
)
def resample_named_units(spark: SparkSession, d: str) -> DataFrame:
    """Candles in other units, whose format the caller names."""
    bars, parts = candles(spark, d, TimeInterval.HOUR), []
    for named, scaled in (("unix_microseconds", lambda c: F.col(c) * 1000), ("unix_seconds", lambda c: F.floor(F.col(c) / 1000))):
        own = bars.withColumns({c: scaled(c) for c in ("open_time", "close_time")})
        parts.append(resample.aggregate_ohlcv(own, "4h", source_interval="1h", timestamp_format=named).select(F.lit(named).alias("named"), "open_time", "close"))
    return rounded(parts[0].unionByName(parts[1]))


@query(
    f"""WITH RECURSIVE {TRADES_SQL}, d AS (SELECT symbol, time // 86400000 AS day, CAST(count(*) AS DOUBLE) AS v FROM trades GROUP BY ALL),
n AS (SELECT symbol, v, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i FROM d), q AS (SELECT 1 - 2.0::DOUBLE / 11 AS q),
e AS (SELECT symbol, i, v AS mean, 1.0::DOUBLE AS w FROM n WHERE i = 0 UNION ALL
  SELECT n.symbol, n.i, (e.mean * q + n.v) / CASE WHEN n.i < 10 THEN 1 + q * (e.w + pow(q, n.i)) / (e.w + pow(q, n.i) + 1) ELSE 1 END, e.w + pow(q, n.i) FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1, q)
SELECT symbol, round(arg_max(mean, i), 6) AS mean FROM e GROUP BY symbol"""
)
def biased_ema_trades(spark: SparkSession, d: str) -> DataFrame:
    """The imbalance bars' mean, of each symbol's trades a day in order of days."""
    daily = trades_from_events(spark, d).groupBy("symbol", F.floor(F.col("time") / 86_400_000).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    series = daily.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("day", "n"))).alias("days")).select("symbol", F.col("days.n").cast("array<double>").alias("n"))  # a number a day

    def means(batches):
        for b in batches:
            yield b.assign(mean=[imbalance.biased_ema(list(n), 10) for n in b["n"]])[["symbol", "mean"]]

    return rounded(series.mapInPandas(means, "symbol string, mean double"))


@query("SELECT unnest(['klines', 'trades', 'aggTrades', 'metrics', 'bookDepth']) AS data_type, unnest(['monthly', 'monthly', 'monthly', 'daily', 'daily']) AS frequency, 'zip' AS extension")
def type_files(spark: SparkSession, d: str) -> DataFrame:
    """How often files of a type come, and what they end in."""
    rows = [(t.value, catalog.get_data_frequency(t).value, catalog.get_file_extension(t)) for t in (DataType.KLINES, DataType.TRADES, DataType.AGG_TRADES, DataType.METRICS, DataType.BOOK_DEPTH)]
    return spark.createDataFrame(rows, "data_type string, frequency string, extension string")
