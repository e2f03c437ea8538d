"""Time, dollar and imbalance bars under Structured Streaming."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratabar.operators.imbalance import ImbalanceLabels
from stratabar.operators.ordering import order_key
from stratabar.operators.timebars import ohlcv_columns

BAR_SCHEMA = "symbol string, bar_id bigint, open_time bigint, close_time bigint, open double, high double, low double, close double, volume double, quote_volume double, num_trades bigint, bar_dollar_volume double, closed boolean"
_STATE = "carry double, bar_id bigint, open_time bigint, close_time bigint, open double, high double, low double, close double, volume double, quote_volume double, num_trades bigint, dollars double"


def stream_time_bars(trades: DataFrame, interval_ms: int, lateness: str = "1 minute", partition_cols: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling bars of a stream of trades. A bar is final once the greatest trade time is past its end by `lateness`;
    trades later than that are dropped, as a watermark does. In update or complete mode open bars show as well. Equals
    the batch bars when no trade is late."""
    event_time = trades.withColumn("_ts", F.timestamp_millis("time")).withWatermark("_ts", lateness)
    window = F.window("_ts", f"{interval_ms} milliseconds")
    bars = event_time.groupBy(*partition_cols, window).agg(*ohlcv_columns(order_key(trades)))
    start = F.unix_millis("window.start")
    return bars.withColumns({"open_time": start, "close_time": start + interval_ms - 1, "ignore": F.lit(0)}).select(
        *partition_cols, "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "count", "taker_buy_volume", "taker_buy_quote_volume", "ignore"
    )


def stream_dollar_bars(trades: DataFrame, threshold: float) -> DataFrame:
    """Fixed dollar bars of each symbol of a stream. State: the carry and the open bar, a few numbers a symbol.

    Trades are folded in (time, trade_id) order within a micro-batch and batch after batch, so the bars equal the
    batch result if batches arrive in time order; trades that arrive later than their neighbours are folded on
    arrival. Emits each bar when it closes, and the open bar (closed = false) as it stands after a batch.
    """
    return trades.groupBy("symbol").applyInPandasWithState(_fold(threshold), BAR_SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)


def _fold(threshold: float):
    """Bar numbers by the closed form of the fixed bars (operators/dollarbars.py), the carry handed on."""
    names = [f.split()[0] for f in _STATE.split(", ")]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["time", "trade_id"], kind="stable").reset_index(drop=True)
        if rows.empty:
            return
        s = dict(zip(names, state.get, strict=True)) if state.exists else {n: 0 for n in names}
        i, sums = np.arange(1, len(rows) + 1), s["carry"] + np.cumsum(rows["quote_quantity"].to_numpy(float))
        full = i + np.minimum(0, np.minimum.accumulate(np.floor(sums / threshold).astype(np.int64) - i))
        rows["bar_id"] = s["bar_id"] + np.concatenate(([0], full[:-1]))
        own = rows.groupby("bar_id", as_index=False).agg(**_BAR)
        own["bar_dollar_volume"] = own["quote_volume"]
        if s["num_trades"]:
            _continue(own, s | {"bar_dollar_volume": s["dollars"]}, ("volume", "quote_volume", "num_trades", "bar_dollar_volume"))
        bar = int(s["bar_id"] + full[-1])
        own["closed"] = own["bar_id"] < bar
        last = own.iloc[-1].to_dict()
        kept = {n: 0 for n in names} if last["closed"] else {n: last.get(n, 0) for n in names} | {"dollars": last["bar_dollar_volume"]}
        kept |= {"carry": float(sums[-1] - full[-1] * threshold), "bar_id": bar}
        state.update(tuple(int(kept[n]) if n in ("bar_id", "open_time", "close_time", "num_trades") else float(kept[n]) for n in names))
        own.insert(0, "symbol", key[0])
        yield own[[f.split()[0] for f in BAR_SCHEMA.split(", ")]]

    return fold


_BAR = dict(
    open_time=("time", "first"), close_time=("time", "last"), open=("price", "first"), high=("price", "max"), low=("price", "min"), close=("price", "last"),
    volume=("quantity", "sum"), quote_volume=("quote_quantity", "sum"), num_trades=("price", "size"),
)


def _continue(own: pd.DataFrame, before: dict, sums: tuple[str, ...]) -> None:
    """The first of a batch's bars goes on with the bar that the batch before left open."""
    for c in ("open_time", "open"):
        own.at[0, c] = before[c]
    own.at[0, "high"], own.at[0, "low"] = max(own.at[0, "high"], before["high"]), min(own.at[0, "low"], before["low"])
    for c in sums:
        own.at[0, c] += before[c]


IMBALANCE_SCHEMA = "symbol string, bar_id bigint, open_time bigint, close_time bigint, open double, high double, low double, close double, volume double, quote_volume double, taker_buy_base_volume double, taker_buy_quote_volume double, num_trades bigint, cumulative_theta double, expected_imbalance double, closed boolean"
_SUMS = ("volume", "quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume", "num_trades")


def stream_imbalance_bars(trades: DataFrame, exp_num_ticks_init: float = 10000, num_prev_bars: int = 3, num_ticks_ewma_window: int = 20, dollar_seed: float | None = None) -> DataFrame:
    """Tick imbalance bars of each symbol of a stream; given dollar_seed, dollar imbalance bars whose first expected
    value it is (the batch operator looks ahead for it). Order and lateness as for dollar bars. State: the open bar and
    the recurrence, which keeps a bit per trade: how far back a close looks follows from the bar it closes."""

    def start() -> ImbalanceLabels:
        return ImbalanceLabels(exp_num_ticks_init, num_prev_bars, num_ticks_ewma_window, dollar_seed is not None)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        labels, price, sign, open_bar = pickle.loads(state.get[0]) if state.exists else (start(), None, 1, None)
        rows = pd.concat(list(batches)).sort_values(["time", "trade_id"], kind="stable").reset_index(drop=True)
        prices = rows["price"].to_numpy(float)
        change = np.sign(np.diff(prices, prepend=prices[0] if price is None else price)).astype(np.int8)
        last_change = np.maximum.accumulate(np.where(change != 0, np.arange(len(change)), -1))
        signs = np.where(last_change >= 0, change[last_change], sign).astype(np.int8)
        price, sign = float(prices[-1]), int(signs[-1])
        table = {"sign": signs, "value": rows["quote_quantity"].to_numpy(float), "seed": np.full(len(rows), dollar_seed or 0.0)}
        rows["bar_id"], rows["theta"], rows["expected"] = (a.to_numpy() for a in labels(pa.table(table)))
        up = signs == 1
        rows["bq"], rows["bqq"] = rows["quantity"].where(up, 0.0), rows["quote_quantity"].where(up, 0.0)
        own = rows.groupby("bar_id", as_index=False).agg(
            **_BAR, taker_buy_base_volume=("bq", "sum"), taker_buy_quote_volume=("bqq", "sum"), cumulative_theta=("theta", "last"), expected_imbalance=("expected", "last"),
        )
        if open_bar is not None and len(own) and own.at[0, "bar_id"] == open_bar["bar_id"]:
            _continue(own, open_bar, _SUMS)
        own["closed"] = own["bar_id"] < labels.bar
        last = own.iloc[-1].to_dict() if len(own) and not own["closed"].iloc[-1] else None
        state.update((pickle.dumps((labels, price, sign, last)),))
        own.insert(0, "symbol", key[0])
        yield own[[f.split()[0] for f in IMBALANCE_SCHEMA.split(", ")]]

    return trades.groupBy("symbol").applyInPandasWithState(fold, IMBALANCE_SCHEMA, "state binary", "append", GroupStateTimeout.NoTimeout)
