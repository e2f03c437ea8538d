"""Trades to tick and dollar imbalance bars."""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratabar.functions.intervals import TimeInterval, bin_start
from stratabar.operators.ordered import fold_ordered
from stratabar.operators.ordering import order_columns, with_keys
from stratabar.operators.timebars import total

#: Values beyond this many steps back weigh under 1e-30 in a mean of window 20.
TAIL = 800
#: Values kept; a mean over more of them than TAIL and a window is a mean of the last TAIL.
KEPT = 1000
#: Signs of a block whose sum is kept.
BLOCK = 4096


def calculate_tick_rule(trades: DataFrame, partition_cols: Sequence[str] = (), bucket_ms: int = TimeInterval.HOUR) -> DataFrame:
    """trades with sign: 1 after a rise, -1 after a fall, as before where the price stays; the first trade has 1.

    In two levels: the last change inside a bucket, else the last one of an earlier bucket."""
    order = order_columns(trades)
    rows, keys, group = with_keys(trades, partition_cols, bucket_ms)
    inside = Window.partitionBy(*group).orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    key = F.struct(*order)
    ends = rows.groupBy(*group).agg(F.max_by("price", key).alias("_close"))
    ends = ends.select(*group, F.last("_close").over(earlier).alias("_before"))
    rows = rows.join(ends, group)
    change = F.col("price") - F.coalesce(F.lag("price").over(inside), F.col("_before"))
    rows = rows.withColumn("_change", F.when(change > 0, 1).when(change < 0, -1))
    rows = rows.withColumn("_last", F.last("_change", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    left = rows.groupBy(*group).agg(F.max_by("_last", key).alias("_left"))
    left = left.select(*group, F.last("_left", ignorenulls=True).over(earlier).alias("_carry"))
    return rows.join(left, group).select(*trades.columns, F.coalesce("_last", "_carry", F.lit(1)).cast("tinyint").alias("sign"))


def biased_ema(values: Sequence[float], window: int) -> float:
    """The mean these bars are defined by. It is no weighted average: each value is added whole, and only the first
    window - 1 steps are divided by 1 + q * w / (w + 1), w being the sum of q^i so far."""
    n = len(values)
    if n < 2:
        return float(values[0]) if n else 0.0
    q = 1 - 2 / (window + 1)
    if n > TAIL + window and q**TAIL < 1e-30:
        mean = 0.0
        for v in values[n - TAIL :]:
            mean = mean * q + v
        return mean
    mean, w = float(values[0]), 1.0
    for i in range(1, n):
        w += q**i
        mean = mean * q + values[i]
        if i < window:
            mean /= 1 + q * w / (w + 1)
    return mean


class _Signs:
    """All signs so far, a bit each, and how many of the last n are +1. How far back a close looks follows from the bar
    that it closes, so no sign can be dropped."""

    def __init__(self) -> None:
        self.blocks: list[bytes] = []
        self.ups = array("q", [0])
        self.open = np.empty(BLOCK, bool)
        self.filled = self.count = 0

    def add(self, signs: np.ndarray) -> None:
        at = 0
        while at < len(signs):
            k = min(BLOCK - self.filled, len(signs) - at)
            self.open[self.filled : self.filled + k] = signs[at : at + k] == 1
            self.filled, at = self.filled + k, at + k
            if self.filled == BLOCK:
                self.blocks.append(np.packbits(self.open).tobytes())
                self.ups.append(self.ups[-1] + int(self.open.sum()))
                self.filled = 0
        self.count += len(signs)

    def _before(self, place: int) -> int:
        block, rest = divmod(place, BLOCK)
        own = np.unpackbits(np.frombuffer(self.blocks[block], np.uint8)) if block < len(self.blocks) else self.open
        return self.ups[block] + int(own[:rest].sum())

    def ups_in_last(self, n: int) -> int:
        return self._before(self.count) - self._before(self.count - n)


class ImbalanceLabels:
    """Bar numbers, running imbalance and reported threshold of ordered trades. The threshold stays within a bar, so its
    end is looked for in cumulative sums over growing pieces: work per bar, not per trade."""

    def __init__(self, init: float, num_prev_bars: int, window: int, dollars: bool):
        self.init, self.prev, self.window, self.dollars = float(init), num_prev_bars, window, dollars
        self.expected_ticks, self.factor, self.value = float(init), 0.01, 1.0
        self.threshold = self.last = None
        self.bar = self.in_bar = 0
        self.theta = 0.0
        self.lengths: deque[int] = deque(maxlen=window)
        self.closed = 0
        self.signs = _Signs()
        self.values: list[float] = []

    def __call__(self, rows: pa.Table) -> list[pa.Array]:
        sign = rows.column("sign").to_numpy().astype(np.int8)
        value = rows.column("value").to_numpy() if self.dollars else np.ones(len(sign))
        signed = sign * value
        if self.threshold is None:
            if self.dollars:
                self.value = float(rows.column("seed")[0].as_py())
            self.threshold = self.expected_ticks * self.factor * self.value
        n = len(sign)
        bars, thetas, reported = np.empty(n, np.int64), np.empty(n), np.empty(n)
        at = 0
        while at < n:
            end, closes = self._end(signed, at)
            thetas[at:end] = self.sums[: end - at]
            bars[at:end] = self.bar
            reported[at:end] = self.last if self.last is not None else self.expected_ticks * 0.01 * self.value
            self.signs.add(sign[at:end])
            if self.dollars:
                self.values = (self.values + value[at:end][-KEPT:].tolist())[-KEPT:]
            self.in_bar += end - at
            self.theta = float(thetas[end - 1])
            if closes:
                reported[end - 1] = self.threshold
                self._close()
            at = end
        return [pa.array(bars), pa.array(thetas), pa.array(reported)]

    def _end(self, signed: np.ndarray, at: int) -> tuple[int, bool]:
        """Where the bar closes, or the batch ends; leaves the running imbalance in self.sums. Sums start at the bar's
        imbalance so far and add trade by trade."""
        size, sums, theta = 64, [], self.theta
        while at < len(signed):
            piece = np.cumsum(np.concatenate(([theta], signed[at : at + size])))[1:]
            hit = np.flatnonzero(np.abs(piece) >= self.threshold)
            if len(hit):
                sums.append(piece[: hit[0] + 1])
                self.sums = np.concatenate(sums)
                return at + int(hit[0]) + 1, True
            sums.append(piece)
            theta, at, size = float(piece[-1]), at + len(piece), min(4 * size, 65536)
        self.sums = np.concatenate(sums)
        return at, False

    def _close(self) -> None:
        self.last = self.threshold
        self.lengths.append(self.in_bar)
        self.closed += 1
        if self.closed > 1:
            own = list(self.lengths)
            self.expected_ticks = max(biased_ema(own, len(own)), 0.1 * self.init)
        if self.signs.count > 10:
            n = max(10, min(int(self.prev * self.expected_ticks), self.signs.count))
            p = min(0.9, max(0.1, self.signs.ups_in_last(n) / n))
            self.factor = max(abs(2 * p - 1), 0.01)
            if self.dollars:
                self.value = biased_ema(self.values[-n:], min(20, n))
        self.threshold = self.expected_ticks * self.factor * self.value
        self.bar, self.in_bar, self.theta = self.bar + 1, 0, 0.0


def _bars(trades: DataFrame, init: float, num_prev_bars: int, window: int, partition_cols: Sequence[str], dollars: bool) -> DataFrame:
    signed = calculate_tick_rule(trades, partition_cols)
    order, key = order_columns(trades), F.struct(*order_columns(trades))
    inputs = {"sign": "sign"}
    if dollars:
        signed = _with_seed(signed, trades, partition_cols, order).withColumn("_v", F.coalesce("quote_quantity", F.lit(0)).cast("double"))
        inputs |= {"value": "_v", "seed": "_seed"}
    labelled = fold_ordered(
        signed, partition_cols, order, inputs, "bar_id bigint, theta double, expected double", lambda: ImbalanceLabels(init, num_prev_bars, window, dollars)
    )

    def bought(c: str) -> Column:
        return F.sum(F.when(F.col("sign") == 1, F.col(c)).otherwise(F.lit(0)))

    price = F.col("price")
    return labelled.groupBy(*partition_cols, "bar_id").agg(
        F.min("time").alias("open_time"), F.max("time").alias("close_time"),
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"),
        total(F.col("quantity")).alias("volume"), total(F.col("quote_quantity")).alias("quote_volume"),
        bought("quantity").alias("taker_buy_base_volume"), bought("quote_quantity").alias("taker_buy_quote_volume"), F.count(F.lit(1)).alias("num_trades"),
        F.max_by("theta", key).alias("cumulative_theta"), F.max_by("expected", key).alias("expected_imbalance"),
    )


def _with_seed(rows: DataFrame, trades: DataFrame, partition_cols: Sequence[str], order: list[str]) -> DataFrame:
    """rows with _seed: the mean quote quantity of a partition's first 1000 trades if it has more, else that of its first
    trade. Taken from the trades as they are read, so nothing of the signs is computed twice; the rank filter reaches the
    map tasks, so 1001 rows of each are dealt at most."""

    def keyed(df: DataFrame) -> tuple[DataFrame, list[str]]:
        own, keys, _ = with_keys(df, partition_cols)
        return (own, keys) if keys else (own.withColumn("_k", F.lit(0)), ["_k"])

    firsts, keys = keyed(trades.select(*partition_cols, *order, "quote_quantity"))
    w = Window.partitionBy(*keys).orderBy(*order)
    first = firsts.select(*keys, *order, "quote_quantity").withColumn("_n", F.row_number().over(w)).filter("_n <= 1001")
    seed = first.groupBy(*keys).agg(
        F.when(F.max("_n") > 1000, F.sum(F.when(F.col("_n") <= 1000, F.col("quote_quantity"))).cast("double") / 1000).otherwise(F.max(F.when(F.col("_n") == 1, F.col("quote_quantity"))).cast("double")).alias("_seed")
    )
    return keyed(rows)[0].join(seed, keys).drop(*keys)


def aggregate_trades_to_tick_imbalance_bars(
    trades: DataFrame, exp_num_ticks_init: float = 10000, num_prev_bars: int = 3, num_ticks_ewma_window: int = 20, ensure_sorted: bool = True, partition_cols: Sequence[str] = ()
) -> DataFrame:
    """Bars that close when the sum of tick signs reaches the expected imbalance, which each close sets anew. The last,
    open bar is included; its expected_imbalance is that of the bar before. Taker volumes follow the tick sign."""
    return _bars(trades, exp_num_ticks_init, num_prev_bars, num_ticks_ewma_window, partition_cols, False)


def aggregate_trades_to_dollar_imbalance_bars(
    trades: DataFrame, exp_num_ticks_init: float = 10000, num_prev_bars: int = 3, num_ticks_ewma_window: int = 20, ensure_sorted: bool = True, partition_cols: Sequence[str] = ()
) -> DataFrame:
    """As tick imbalance bars, with signs weighed by quote quantity and the threshold by its expected value."""
    return _bars(trades, exp_num_ticks_init, num_prev_bars, num_ticks_ewma_window, partition_cols, True)
