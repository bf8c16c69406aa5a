"""The registered queries against their SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from barloom.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: One of each kind; the driver compares all of them.
CHOSEN = [
    "alpha_003", "alpha_029", "alpha_064", "alpha_100", "operator_ts_rank", "operator_indneutralize", "liquidity_mask", "composite", "ic_series", "quantile_returns", "top_turnover", "trade_signals", "fundamental_panel",
    "as_of_bounded", "newey_west", "strategy_momentum", "strategy_market_neutral", "strategy_icir_weight", "portfolio_metrics", "backtest", "strategy_metrics", "event_study", "parameter_grid", "day_factors", "neutralize", "quantile_cohorts", "dynamic_universe",
    "build_targets", "price_limits", "account_replay", "snapshot_changes", "snapshot_retention", "keyed_upsert", "vendor_flatten", "quarter_ends", "attention_funnel", "stream_tumbling_bars",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == rows


def test_events_of_one_time_count_in_the_quality(spark, tmp_path):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    con.execute(f"create table events as select event_id * 3 + k as event_id, ts, user_id, event_type, value + k as value, props from '{DATA}/events.parquet', range(3) t(k)")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = QUERIES["minute_quality"](spark, str(tmp_path))
    want = con.execute(SQL["minute_quality"])
    columns = [d[0] for d in want.description]
    rows = sorted(tuple(plain(v) for v in r) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == rows
    assert sum(float(r[columns.index("minute_count")]) for r in rows) > con.execute("select count(distinct (event_type, ts)) from events").fetchone()[0]


def test_every_query_is_registered(spark):
    assert set(SQL) <= set(QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["simulate", "account_step", "strategy_ml", "strategy_lasso", "strategy_pairs"])
def test_queries_without_sql_run(spark, name):
    rows = QUERIES[name](spark, DATA).count()  # the smallest tables are too short for some of them to act
    assert rows > 0 or name == "simulate"


def test_streamed_accounts_equal_the_batch(spark):
    key = lambda rows: sorted(tuple(r.asDict().items()) for r in rows)
    got, want = (key(QUERIES[n](spark, DATA).collect()) for n in ("stream_account_step", "account_step"))
    assert got == want and len(got) > 100
