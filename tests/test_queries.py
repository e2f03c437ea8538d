import os

import duckdb
import pytest

from stratabar.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def same(v):
    return f"{v:.6g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(same, r)) for r in df.select(*columns).collect())
    assert got or name == "compare_frames"
    if name in SQL:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
        rel = con.execute(SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted(tuple(same(r[i]) for i in at) for r in rel.fetchall())


def test_streams_equal_batches(spark):
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert key(QUERIES["stream_ohlcv_1h"](spark, SF)) == key(QUERIES["ohlcv_1h"](spark, SF))
    from stratabar.operators.dollarbars import aggregate_trades_to_dollar_bars_fixed
    from stratabar.plans.trades import trades_from_events

    streamed = {(r["symbol"], r["bar_id"]): (r["num_trades"], round(r["volume"], 4)) for r in QUERIES["stream_dollar_bars_by_symbol"](spark, SF).orderBy("closed").collect()}
    batch = aggregate_trades_to_dollar_bars_fixed(trades_from_events(spark, SF), 100_000.0, partition_cols=["symbol"])
    assert streamed == {(r["symbol"], r["bar_id"]): (r["num_trades"], round(r["volume"], 4)) for r in batch.collect()}
