import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.functions.semantics import asof
from tidemark.operators import features, fx, ledger, quality, risk, statistics
from tidemark.sources.bars import BAR_SCHEMA
from tests.causality import walk


def day(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=i)


def test_an_edited_ledger_is_found(spark):
    events = spark.createDataFrame([(a, i, f"{a}{i}") for a in "xy" for i in range(5)], "account string, seq long, record string")
    good = ledger.chain(events).cache()
    assert ledger.verify(good).count() == 0
    edited = good.withColumn("record", F.when((F.col("account") == "x") & (F.col("seq") == 2), "other").otherwise(F.col("record")))
    assert [(r.account, r.seq) for r in ledger.verify(edited).collect()] == [("x", 2)]
    assert {r.problem for r in ledger.verify(good.where("not (account = 'y' and seq = 3)")).collect()} == {"does not follow the record before"}


def test_fingerprint_ignores_row_order(spark):
    df = spark.createDataFrame(walk(40, 1), BAR_SCHEMA)
    a, b = (ledger.fingerprint(x, ("symbol",), ("ts",), ("close",)).collect() for x in (df, df.orderBy(F.desc("ts")).repartition(5)))
    assert a == b
    assert ledger.fingerprint(df.withColumn("close", F.col("close") + 1e-9), ("symbol",), ("ts",), ("close",)).collect() != a


def test_each_rule_excludes_its_row(spark):
    ok = (10.0, 11.0, 9.0, 10.0, 5.0, 10.0)
    bad = {
        "null_value": (None, *ok[1:]), "non_finite_value": (math.inf, *ok[1:]), "non_positive_price": (10.0, 11.0, 0.0, 10.0, 5.0, 10.0), "non_positive_adj_close": (*ok[:5], -1.0),
        "ohlc_inconsistent": (10.0, 9.5, 9.0, 10.0, 5.0, 10.0), "negative_volume": (*ok[:4], -1.0, 10.0),
    }
    rows = [("A", day(i), *v) for i, v in enumerate(bad.values())] + [("A", day(90), *ok), ("A", day(20), *ok), ("A", day(20), *ok), ("A", day(21), *ok), ("A", day(21), *ok[:4], 6.0, 10.0), ("A", day(22), *ok)]
    out = quality.validate(spark.createDataFrame(rows, BAR_SCHEMA), F.lit("2024-03-01").cast("timestamp_ntz")).collect()
    by = {}
    for r in out:
        by.setdefault((r.ts - day(0)).days, []).append(r.rule)
    assert [by[i][0] for i in range(len(bad))] == list(bad) and by[90] == ["future_bar"]
    assert sorted(by[20], key=str) == [None, "duplicate_bar"] and by[21] == ["conflicting_duplicate_bar"] * 2 and by[22] == [None]
    kept = quality.accept(quality.validate(spark.createDataFrame(rows, BAR_SCHEMA), F.lit("2024-03-01").cast("timestamp_ntz")))
    assert kept.count() == 2


def test_holm_and_bh_known_values(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "name string, p double")
    out = {r.name: r for r in statistics.adjust(p).collect()}
    assert [round(out[k].p_holm, 6) for k in "acb"] == [0.04, 0.09, 0.09] and out["d"].p_holm is None and out["a"].family_size == 4
    assert [round(out[k].p_bh, 6) for k in "acb"] == [0.04, 0.053333, 0.053333]


def test_bootstrap_is_repeatable_and_covers(spark):
    rows = [("s", day(i), 0.001 * (i % 7 - 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, daily_return double")
    a = statistics.bootstrap(df, "k", resamples=64, block=10, seed=3).orderBy("metric").collect()
    b = statistics.bootstrap(df.repartition(3), "k", resamples=64, block=10, seed=3).orderBy("metric").collect()
    assert a == b and all(r.low <= r.median <= r.high and r.finite == 64 for r in a)


def test_asof_ties_and_strictness(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, ts int")
    right = spark.createDataFrame([("a", 5, 50.0), ("a", 3, 30.0)], "k string, ts int, v double")
    rows = lambda df: [(r.k, r.ts, r.v) for r in df.orderBy("k", "ts").collect()]
    assert rows(asof(left, right, "v", "k")) == [("a", 1, None), ("a", 5, 50.0), ("b", 5, None)]
    assert rows(asof(left, right, "v", "k", strict=True)) == [("a", 1, None), ("a", 5, 30.0), ("b", 5, None)]


def test_trading_day_rolls_with_daylight_saving(spark):
    times = ["2024-01-05 21:59:00", "2024-01-05 22:00:00", "2024-07-05 20:59:00", "2024-07-05 21:00:00"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    out = df.select("ts", calendar.trading_day(F.col("ts")).alias("d"), calendar.market_open(F.col("ts")).alias("o")).orderBy("ts").collect()
    assert [str(r.d) for r in out] == ["2024-01-05", "2024-01-06", "2024-07-05", "2024-07-06"] and [r.o for r in out] == [True, False, True, False]


def test_weekdays(spark):
    import numpy as np

    pairs = [(dt.date(2024, 1, 1) + dt.timedelta(days=a), dt.date(2024, 1, 1) + dt.timedelta(days=a + n)) for a in range(9) for n in range(20)]
    out = spark.createDataFrame(pairs, "a date, z date").select("a", "z", calendar.weekdays_between(F.col("a"), F.col("z")).alias("n")).collect()
    assert all(r.n == np.busday_count(r.a + dt.timedelta(days=1), r.z + dt.timedelta(days=1)) for r in out)


def test_drawdown_lock_ends_and_resets(spark):
    values = [100, 95, 89, 79, 60, 61, 62, 70]
    df = spark.createDataFrame([("s", day(i), float(v)) for i, v in enumerate(values)], "k string, ts timestamp_ntz, equity double")
    out = [r.risk_state for r in risk.drawdown_states(df, "k", cooldown=2).orderBy("ts").collect()]
    assert out == ["NORMAL", "NORMAL", "WARNING", "LOCKED", "LOCKED", "LOCKED", "NORMAL", "NORMAL"]


def hours(spark, rows, gaps=()):
    at = [START_OF_WEEK + dt.timedelta(hours=i + 50 * sum(g <= i for g in gaps)) for i in range(len(rows))]
    return at, spark.createDataFrame([("A", t, *map(float, r), 1.0, None) for t, r in zip(at, rows)], BAR_SCHEMA)


START_OF_WEEK = dt.datetime(2024, 1, 8, 12)
SIGNAL = "symbol string, ts timestamp_ntz, dir int, stop_dist double, target_dist double, max_hold int"
FREE = {"spread": 0.0, "commission": 0.0, "least": 0.0, "financing": 0.0}


@pytest.mark.parametrize(
    "direction, rows, hold, gaps, want",
    [
        (1, [(100, 101, 99, 100), (100, 101, 99, 100), (90, 111, 89, 90), (90, 91, 89, 90)], 9, (), ("stop_gap", 90.0, 2, -2.0)),
        (1, [(100, 101, 99, 100), (100, 111, 94, 100), (90, 111, 89, 90)], 9, (), ("stop", 95.0, 1, -1.0)),
        (1, [(100, 101, 99, 100), (100, 101, 99, 100), (112, 113, 99, 100), (1, 1, 1, 1)], 9, (), ("target_gap", 112.0, 2, 2.4)),
        (-1, [(100, 101, 99, 100), (100, 101, 89, 100), (100, 101, 99, 100)], 9, (), ("target", 90.0, 1, 2.0)),
        (-1, [(100, 101, 99, 100), (100, 101, 99, 99), (99, 101, 99, 98), (98, 98, 98, 98)], 2, (), ("time", 98.0, 2, 0.4)),
        (1, [(100, 101, 99, 100), (100, 101, 99, 101), (99, 101, 99, 98), (98, 98, 98, 98)], 9, (2,), ("weekend", 101.0, 1, 0.2)),
        (1, [(100, 101, 99, 100), (100, 101, 99, 101)], 9, (), ("weekend", 101.0, 1, 0.2)),
    ],
)
def test_bracket_exit_order(spark, direction, rows, hold, gaps, want):
    at, bars = hours(spark, rows, gaps)
    (t,) = fx.bracket_trades(bars, spark.createDataFrame([("A", at[0], direction, 5.0, 10.0, hold)], SIGNAL), **FREE).collect()
    assert (t.reason, t.exit, t.bars) == want[:3] and t.r_net == pytest.approx(want[3])


def test_bracket_entries_and_costs(spark):
    at, bars = hours(spark, [(100, 101, 99, 100)] * 8, gaps=(6,))
    signals = [("A", at[i], 1, 5.0, 10.0, 2) for i in (0, 1, 2, 5, 7)] + [("A", at[3], 1, None, 10.0, 2), ("A", at[4], 1, 0.0, 10.0, 2)]
    out = fx.bracket_trades(bars, spark.createDataFrame(signals, SIGNAL), spread=0.001).orderBy("signal_ts").collect()
    # The second signal falls into the first trade; that of the exit bar is taken; none enters over a pause, at the end, or unsound.
    assert [(t.signal_ts, t.exit_ts) for t in out] == [(at[0], at[2]), (at[2], at[4])]
    entry, close = 100 * 1.0005, 100 * 0.9995
    units = 10_000 * 0.005 * 1.1 / 5
    assert out[0].r_gross == pytest.approx((close - entry) / 5) and out[0].r_cost == pytest.approx(2 * max(2.0, 0.2e-4 * units * entry) / 55)
    assert fx.bracket_trades(bars.limit(0), spark.createDataFrame([], SIGNAL)).count() == 0


def test_split_has_no_overlap(spark):
    out = features.assemble(spark.createDataFrame(walk(100, 2), BAR_SCHEMA)).groupBy("period").agg(F.min("ts").alias("a"), F.max("ts").alias("z")).collect()
    by = {r.period: r for r in out}
    assert by["train"].z < by["validation"].a and by["validation"].z < by["test"].a
