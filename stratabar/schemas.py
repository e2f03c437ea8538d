"""Schemas of archive data types and the names that different producers use for the same measures."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


class Market(Enum):
    SPOT = "spot"
    USD_M = "um"
    COIN_M = "cm"
    OPTION = "option"


class Frequency(Enum):
    DAILY = "daily"
    MONTHLY = "monthly"


class DataType(Enum):
    KLINES = "klines"
    TRADES = "trades"
    AGG_TRADES = "aggTrades"
    BOOK_TICKER = "bookTicker"
    METRICS = "metrics"
    FUNDING_RATE = "fundingRate"
    BOOK_DEPTH = "bookDepth"
    PREMIUM_INDEX_KLINES = "premiumIndexKlines"
    MARK_PRICE_KLINES = "markPriceKlines"
    INDEX_PRICE_KLINES = "indexPriceKlines"
    LIQUIDATION_SNAPSHOT = "liquidationSnapshot"


# The columns of each archive type, in file order.
_KLINES = "open_time bigint, open double, high double, low double, close double, {v} {t}, close_time bigint, {q} {t}, {n} bigint, {b} {t}, {bq} {t}, ignore bigint"
_LONG_NAMES = {"v": "volume", "q": "quote_asset_volume", "n": "number_of_trades", "b": "taker_buy_base_asset_volume", "bq": "taker_buy_quote_asset_volume"}
_SHORT_NAMES = {"v": "volume", "q": "quote_volume", "n": "count", "b": "taker_buy_volume", "bq": "taker_buy_quote_volume"}
SCHEMAS: dict[DataType, str] = {
    DataType.KLINES: _KLINES.format(t="double", **_LONG_NAMES),
    DataType.TRADES: "trade_id bigint, price double, quantity double, quote_quantity double, time bigint, is_buyer_maker boolean",
    DataType.AGG_TRADES: "agg_trade_id bigint, price double, quantity double, first_trade_id bigint, last_trade_id bigint, timestamp bigint, is_buyer_maker boolean",
    DataType.BOOK_TICKER: "update_id bigint, best_bid_price double, best_bid_qty double, best_ask_price double, best_ask_qty double, transaction_time bigint, event_time bigint",
    DataType.METRICS: "create_time string, symbol string, sum_open_interest double, sum_open_interest_value double, count_toptrader_long_short_ratio double, sum_toptrader_long_short_ratio double, count_long_short_ratio double, sum_taker_long_short_vol_ratio double",
    DataType.FUNDING_RATE: "calc_time bigint, funding_interval_hours bigint, last_funding_rate double",
    DataType.BOOK_DEPTH: "timestamp string, percentage bigint, depth double, notional double",
    DataType.PREMIUM_INDEX_KLINES: _KLINES.format(t="bigint", **_SHORT_NAMES),
    DataType.MARK_PRICE_KLINES: _KLINES.format(t="bigint", **_SHORT_NAMES),
    DataType.INDEX_PRICE_KLINES: _KLINES.format(t="double", **_SHORT_NAMES),
}
#: The column that orders rows of a type; strings are written as %Y-%m-%d %H:%M:%S.
TIME_COLUMNS: dict[DataType, str] = {
    DataType.KLINES: "open_time", DataType.TRADES: "time", DataType.AGG_TRADES: "timestamp", DataType.BOOK_TICKER: "transaction_time", DataType.METRICS: "create_time",
    DataType.FUNDING_RATE: "calc_time", DataType.BOOK_DEPTH: "timestamp", DataType.PREMIUM_INDEX_KLINES: "open_time", DataType.MARK_PRICE_KLINES: "open_time", DataType.INDEX_PRICE_KLINES: "open_time",
}
KLINE_LIKE = frozenset({DataType.KLINES, DataType.PREMIUM_INDEX_KLINES, DataType.MARK_PRICE_KLINES, DataType.INDEX_PRICE_KLINES})
#: Header names of trade files (lower case) and the names used here.
HEADER_SYNONYMS = {"id": "trade_id", "qty": "quantity", "quote_qty": "quote_quantity", "isbuyermaker": "is_buyer_maker", "is_buyer_maker": "is_buyer_maker"}
#: The same measures in time bars, candles of exchanges, and dollar or imbalance bars.
CANDLE_NAMES = {"quote_volume": "quote_asset_volume", "count": "number_of_trades", "taker_buy_volume": "taker_buy_base_asset_volume", "taker_buy_quote_volume": "taker_buy_quote_asset_volume"}
BAR_NAMES = {"count": "num_trades", "taker_buy_volume": "taker_buy_base_volume"}


def get_data_type_schema(data_type: DataType) -> StructType:
    """The columns of an archive type. Raises ValueError for types without a known layout."""
    if data_type not in SCHEMAS:
        raise ValueError(f"no schema for {data_type.value}")
    return StructType.fromDDL(SCHEMAS[data_type])


def get_data_config(name: str) -> dict:
    """Older names: klines and trades keep integer times; names with _v1, aggTrades and bookTicker list the columns to
    turn into timestamps."""
    base, v1 = name.removesuffix("_v1"), name.endswith("_v1")
    data_type = DataType(base)
    if data_type not in (DataType.KLINES, DataType.TRADES, DataType.AGG_TRADES, DataType.BOOK_TICKER) or (v1 and base not in ("klines", "trades")):
        raise ValueError(f"unknown data type {name}")
    schema = get_data_type_schema(data_type)
    times = [c for c in schema.names if c in ("open_time", "close_time", "time", "timestamp", "transaction_time", "event_time")]
    return {"columns": schema.names, "schema": schema, "timestamp_cols": times if v1 or base in ("aggTrades", "bookTicker") else []}


def to_candle_names(bars: DataFrame) -> DataFrame:
    """Time bars in the names of exchange candles, so resampling and comparison see every measure."""
    return bars.withColumnsRenamed({a: b for a, b in CANDLE_NAMES.items() if a in bars.columns})
