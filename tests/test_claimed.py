"""Rows of the inventory that the README claims: p-values, open positions, fills, refused revisions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, portfolio, statistics
from tidemark.streaming import bars as streaming

START = dt.datetime(2024, 1, 1)


def day(i):
    return START + dt.timedelta(days=i)


def test_p_values_equal_the_formulas(spark):
    series = {"up": np.random.default_rng(1).normal(0.002, 0.02, 150), "down": np.random.default_rng(2).normal(-0.01, 0.02, 150), "few": np.full(9, 0.1)}
    df = spark.createDataFrame([(k, day(i), float(x)) for k, v in series.items() for i, x in enumerate(v)], "k string, ts timestamp_ntz, daily_return double")
    two = {r.k: r for r in statistics.bootstrap(df, "k", resamples=300, block=5, seed=3).where("metric = 'mean_return'").collect()}
    one = {r.k: r.p for r in statistics.one_sided(df.withColumnRenamed("daily_return", "r"), "k", resamples=400).collect()}
    for k in ("up", "down"):
        r = series[k]
        means = r[statistics.block_positions(150, 300, 5, 3)].mean(1)
        assert two[k].finite == 300 and two[k].p_value == pytest.approx((1 + np.count_nonzero(abs(means - r.mean()) >= abs(r.mean()))) / 301)
    means = series["up"][statistics.block_positions(150, 400, 5, 7)].mean(1) - series["up"].mean()
    assert one["up"] == pytest.approx((1 + np.count_nonzero(means >= series["up"].mean())) / 401)
    assert one["down"] == 1.0 and one["few"] is None


def test_open_position_and_fills(spark):
    rows = [("s", day(i), 10.0 + i, 10.5 + i, t) for i, t in enumerate([1.0, 0.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, close double, target double")
    args = df.select("symbol", "ts", "target"), df.select("symbol", "ts", "open", "close")
    fills = portfolio.fills(*args).orderBy("ts").collect()
    assert [(f.side, f.ts, f.price, f.signal_observed_at) for f in fills] == [("BUY", day(1), 11.0, day(0)), ("SELL", day(2), 12.0, day(1)), ("BUY", day(3), 13.0, day(2))]
    for f in fills:
        assert (f.commission, f.spread_cost, f.slippage_cost) == pytest.approx((1.0, f.notional * 1e-4, f.notional * 2e-4)) and f.notional == pytest.approx(f.price * f.shares)
        assert f.total_cost == pytest.approx(f.commission + f.spread_cost + f.slippage_cost)
    (mark,) = portfolio.open_positions(*args).collect()
    assert (mark.entry_ts, mark.mark_ts, mark.mark_price, mark.shares) == (day(3), day(4), 14.5, fills[2].shares)
    assert mark.unrealized_net_pnl == pytest.approx(mark.shares * 1.5 - fills[2].total_cost)
    assert portfolio.trades(*args).count() == 1
    assert portfolio.open_positions(args[0].withColumn("target", F.lit(0.0)), args[1]).count() == 0


def test_sink_refuses_revisions(spark, tmp_path):
    write = streaming.keyed_sink(spark, f"{tmp_path}/t", ("account", "session"))
    rows = lambda *r: spark.createDataFrame(r, "account string, session int, v double")
    write(rows(("a", 1, 5.0), (None, 1, None)), 0)
    write(rows(("a", 1, 5.0), (None, 1, None), ("a", 2, 1.0)), 1)
    for bad in (rows(("a", 1, 5.5), ("b", 1, 1.0)), rows(("c", 1, 1.0), ("c", 1, 2.0)), rows((None, 1, 0.0))):
        with pytest.raises(ValueError, match="revision"):
            write(bad, 2)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3


def test_forest_has_the_trees_of_the_reference(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(features, "_fit", lambda df, names, classifier: seen.append(classifier.getNumTrees()))
    features.forest_probabilities(None, features.NAMES)
    assert seen == [300]
