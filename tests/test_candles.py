"""Hand examples of geometry and patterns, and causality of every column."""

import datetime as dt

from tidemark.operators import candles, indicators, portfolio, regimes, structure
from tidemark.sources.bars import BAR_SCHEMA
from tests.causality import assert_causal, walk

import pytest


def frame(spark, rows):
    day = dt.datetime(2024, 1, 2)
    return spark.createDataFrame([("A", day + dt.timedelta(days=i), *map(float, r), 1e6, None) for i, r in enumerate(rows)], BAR_SCHEMA)


def found(spark, rows):
    out = candles.observations(candles.geometry(frame(spark, rows))).collect()
    last = max(r.ts for r in out) if out else None
    return {r.pattern: r for r in out if r.ts == last}


DOWN = [(100 - i, 100.2 - i, 98.9 - i, 99 - i) for i in range(12)]


def test_hammer_needs_a_fall_before_it(spark):
    hammer = (88, 88.3, 85, 88.2)
    r = found(spark, [*DOWN, hammer])["hammer"]
    assert r.context_met and r.trend_before == "down" and r.orientation == "bullish"
    assert "hammer" not in found(spark, [hammer] * 3) and "hanging_man" not in found(spark, [*DOWN, hammer])


def test_engulfing_strength_is_logarithmic(spark):
    r = found(spark, [*DOWN, (88, 88.1, 86.9, 87), (86.9, 91, 86.8, 90.9)])["bullish_engulfing"]
    assert r.strength == pytest.approx(0.60206, abs=1e-5)  # four bodies of ten


def test_thresholds(spark):
    assert "doji" in found(spark, [(10, 10.5, 9.5, 10.1)]) and "doji" not in found(spark, [(10, 10.5, 9.5, 10.11)])
    assert "marubozu" in found(spark, [(10, 11, 10, 10.95)])
    g = candles.geometry(frame(spark, [(10, 10, 10, 10), (10, 9, 11, 10)])).collect()
    assert g[0].zero_range and g[0].body_ratio is None and g[0].direction == "neutral" and not g[1].valid and g[1].direction == "invalid" and g[1].range is None


@pytest.mark.parametrize("op", [candles.geometry, lambda b: candles.observations(candles.geometry(b)), indicators.analyse, structure.structure, structure.ranges], ids=["geometry", "observations", "indicators", "structure", "ranges"])
def test_no_value_depends_on_later_bars(spark, op):
    assert_causal(spark, op, walk(120, seed=3))


def test_a_leak_is_noticed(spark):
    from pyspark.sql import functions as F

    from tidemark.functions.semantics import by

    leaky = lambda b: b.select("symbol", "ts", F.lead("close").over(by()).alias("x"))
    with pytest.raises(AssertionError):
        assert_causal(spark, leaky, walk(40, seed=1))


def test_percentile_counts_ties_half(spark):
    df = spark.createDataFrame([("A", i, float(x)) for i, x in enumerate([1, 2, 2, 3, 2])], "symbol string, ts int, x double")
    out = regimes.causal_percentile(df, "x", "p", "n", 4, 2).orderBy("ts").collect()
    assert [r.p for r in out] == [None, None, 0.75, 1.0, 0.5] and [r.n for r in out] == [0, 1, 2, 3, 4]


def test_fold_with_costs_and_closed_form(spark):
    rows = [(10, 11, 9, 10), (10, 12, 9, 11), (12, 13, 11, 12), (12, 12, 8, 9), (9, 10, 8, 10)]
    bars = frame(spark, rows)
    targets = bars.select("symbol", "ts").orderBy("ts").toPandas().assign(target=[1.0, 1.0, 0.0, 0.0, 0.0])
    targets = spark.createDataFrame(targets, "symbol string, ts timestamp_ntz, target double")
    free = portfolio.simulate(targets, bars, costs=portfolio.Costs().free()).orderBy("ts").collect()
    closed = portfolio.zero_cost_equity(targets, bars).orderBy("ts").collect()
    assert [r.equity for r in free] == pytest.approx([r.equity for r in closed])
    assert [r.equity for r in free] == pytest.approx([100_000, 110_000, 120_000, 120_000, 120_000])
    (t,) = portfolio.trades(targets, bars).collect()
    n = (100_000 - 1) / (1 + 3 / 1e4)
    sold = n / 10 * 12
    assert t.net_pnl == pytest.approx(sold - (1 + sold * 3 / 1e4) - 100_000) and t.holding_sessions == 2
