"""Queries and their SQL read whole tables and take all strategies."""

import os
from bisect import bisect_right

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.test_registry import TABLES
from tidemark.operators import portfolio, strategies
from tidemark.plans import portfolio_queries, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def days(table, column):
    return np.array(pq.read_table(f"{SF}/{table}.parquet", columns=[column])[column].to_pylist(), dtype="datetime64[D]")


def test_staleness_reads_all_orders_and_ship_dates(spark):
    priorities, ordered = pq.read_table(f"{SF}/orders.parquet", columns=["o_orderpriority"])["o_orderpriority"].to_pylist(), days("orders", "o_orderdate")
    want = {}
    for k in set(priorities):
        known = sorted({d for p, d in zip(priorities, ordered, strict=True) if p == k})
        for ts in np.unique(days("lineitem", "l_shipdate")):
            i = bisect_right(known, ts)
            want[k, ts.item()] = int(np.busday_count(known[i - 1] + 1, ts + 1)) if i else -1
    got = registry.queries()["join_05_staleness"](spark, SF).collect()
    assert len(got) == len(want) and {(r.k, r.ts): r.stale for r in got} == want


NAMES = {s.name for s in strategies.BASELINES}
EQUITY_ROWS = ("agg_03_drawdown", "agg_05_return_metrics", "agg_11_concentration", "agg_12_redundancy", "agg_25_subperiods", "agg_46_interval", "src_30_returns_matrix")


@pytest.mark.parametrize("name", EQUITY_ROWS)
def test_sql_of_equity_takes_all_strategies(name):
    """The registry test holds the queries to this SQL; here, that it leaves out no strategy."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    rows = [dict(zip(columns, r)) for r in cursor.fetchall()]
    if name == "src_30_returns_matrix":
        assert NAMES <= set(columns)
    else:
        assert {r[c] for r in rows for c in ("strategy", "first", "second") if c in r} == NAMES


def test_simulations_and_bootstrap_take_all_strategies(spark):
    bars, targets = portfolio_queries.signals(spark, SF)
    free = portfolio.simulate(targets, bars, "symbol", "strategy", costs=portfolio.Costs().free())
    folded = {(r.symbol, r.strategy, r.ts): r.equity for r in free.collect()}
    closed = {(r.symbol, r.strategy, r.ts): r.equity for r in portfolio_queries.equity(spark, SF).collect()}
    assert {k[1] for k in closed} == NAMES and folded.keys() == closed.keys()
    assert all(abs(folded[k] - v) <= 1e-6 * v for k, v in closed.items())
    out = portfolio_queries.stat_03_bootstrap(spark, SF).collect()
    keys = {k[:2] for k in closed}
    assert len(out) == 4 * len(keys) and {(r.symbol, r.strategy) for r in out} == keys
    assert {r.finite for r in out if r.metric == "mean_return"} == {2000}
