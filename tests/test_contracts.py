"""Contracts, rates, costs and calendars on small cases: nulls, empty tables, ties, daylight saving."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators import allocation, contracts

BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double"


def bars(spark, rows):
    return spark.createDataFrame(rows, BAR)


def at(hour, minute=0):
    return datetime(2024, 1, 2, hour, minute)


def test_grid_counts_each_fault(spark):
    good = [("a", at(h), 2.0, 3.0, 1.0, 2.0) for h in range(10)]
    bad = [("b", at(0), 2.0, 1.0, 1.0, 2.0), ("b", at(1), None, 3.0, 1.0, 2.0), ("b", at(1), None, 3.0, 1.0, 2.0), ("b", at(2, 30), float("nan"), 3.0, 1.0, -2.0)]
    got = {r.symbol: r for r in contracts.grid_check(bars(spark, good + bad), 60).collect()}
    assert (got["a"].bars, got["a"].adjacent, got["a"].reason) == (10, 0.9, "")
    b = got["b"]
    assert (b.bars, b.off_grid, b.bad_price, b.reason) == (3, 1, 2, "off_grid") and b.inconsistent >= 1
    assert contracts.grid_check(bars(spark, []), 60).count() == 0


def test_closed_leaves_out_the_running_bar(spark):
    rows = [("a", at(h), 1.0, 1.0, 1.0, 1.0) for h in (8, 9, 10)]
    assert contracts.closed(bars(spark, rows), 60, "2024-01-02 10:00:00").count() == 2


def test_signals_without_direction_have_nothing_to_keep(spark):
    rows = [("a", 0, None, None, None, None), ("a", 1, 0.0, 1.0, 0.5, 1), ("a", 2, 1.0, float("inf"), 1.5, 0), ("a", None, 1.0, 1.0, 0.5, 1)]
    df = spark.createDataFrame(rows, "symbol string, dir int, stop_dist double, target_dist double, score double, max_hold int")
    r = contracts.signal_contract(df).first()
    assert (r.rows, r.bad_dir, r.bad_stop_dist, r.bad_target_dist, r.bad_score, r.bad_max_hold) == (4, 2, 1, 1, 1, 1)


def test_safety_rules_of_a_snapshot(spark):
    df = spark.createDataFrame([(1, -1.0, -2.0, 1.5, 90.0, 5.0), (2, 1.0, 0.0, 1.0, 110.0, 10.0), (3, None, None, None, None, None)], "id int, cash double, position double, exposure double, equity double, pnl double")
    got = {(r.id, r.rule) for r in contracts.snapshot_safety(df, F.lit(100.0)).collect()}
    assert got == {(1, n) for n in ("negative_cash", "negative_position", "exposure_above_limit", "accounting")}


def test_portable_moves_stay_undefined_and_ranks_take_the_middle_of_ties(spark):
    df = spark.range(150).select(F.lit("a").alias("symbol"), F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("ts"), *[F.lit(v).alias(c) for c, v in (("open", 2.0), ("high", 3.0), ("low", 1.0), ("close", 2.0))])
    rows = contracts.portable(df, 60).orderBy("ts").collect()
    assert rows[0].move1 is None and rows[0].volatility_rank is None and rows[0].atr is None
    last = rows[-1]
    n = 150 - 13
    assert last.move16 == 0.0 and last.rsi_centered == 0.0 and last.efficiency is None
    assert last.volatility_rank == pytest.approx((n + 1) / 2 / n)


def test_label_view_tells_the_label_before(spark):
    labels = ["x", "x", "y", "x", "x"]
    df = spark.createDataFrame([("a", at(i), x) for i, x in enumerate(labels)], "symbol string, ts timestamp_ntz, label string")
    got = [(r.age, r.changed, r.previous) for r in contracts.label_view(df).orderBy("ts").collect()]
    assert got == [(1, False, None), (2, False, None), (1, True, "x"), (1, True, "y"), (2, False, "y")]


def test_rate_is_that_of_the_day_before(spark):
    days = spark.createDataFrame([("a", datetime(2024, 1, d)) for d in (1, 2, 5)], "symbol string, ts timestamp_ntz")
    rates = spark.createDataFrame([("a", datetime(2024, 1, 2), 0.36), ("a", datetime(2024, 1, 5), 9.0)], "symbol string, ts timestamp_ntz, rate double")
    got = [r.cash_return for r in allocation.cash_returns(days, rates, "symbol").orderBy("ts").collect()]
    assert got[:2] == [None, None] and got[2] == pytest.approx(0.36 * 3 / 360)
    audit = allocation.rate_audit(days, rates, "symbol").first()
    assert (audit.checked, audit.without_rate, audit.max_stale, audit.max_gap) == (3, 1, 0, 3)


def test_drift_rule(spark):
    cases = [("LONG", "CASH", 0.5, True), ("LONG", "LONG", 0.6, False), ("LONG", "LONG", 0.63, True), ("CASH", "CASH", 0.9, False), ("LONG", None, 0.5, False), ("INSUFFICIENT_DATA", "LONG", 0.9, False), ("CASH", "LONG", None, True), (None, "LONG", 0.9, False)]
    df = spark.createDataFrame(cases, "s string, b string, w double, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", allocation.needs_trade(F.col("s"), F.col("b"), F.col("w"), F.lit(0.5))).collect())


def test_smallest_viable_capital(spark):
    runs = spark.createDataFrame([("s", 10, 1.0), ("s", 0, 1.0)], "strategy string, trades int, years double")
    got = {r.capital: r for r in allocation.viable_capital(runs, (1000, 10_000, 100_000), "strategy", limit=1.0).collect()}
    assert got[1000].cost_pct == pytest.approx(100 * 10 * 3.6 / 2000) and [c for c in got if got[c].reference] == [10_000]


def test_sessions_move_with_daylight_saving(spark):
    days = spark.createDataFrame([(date(2024, 3, 8),), (date(2024, 3, 9),), (date(2024, 3, 11),), (date(2024, 3, 11),), (None,)], "day date")
    rows = calendar.auction_windows(calendar.schedule(days, "XNYS")).orderBy("day").collect()
    assert [(r.day.day, r.open_utc.hour, r.close_utc.hour) for r in rows] == [(8, 14, 21), (11, 13, 20)]
    assert rows[0].opens_at is None and rows[1].opens_at == datetime(2024, 3, 9, 0, 1) and rows[1].closes_at == datetime(2024, 3, 11, 13, 27)


def test_no_bars_give_no_window(spark):
    assert allocation.evaluable_start(bars(spark, [])).count() == 0
