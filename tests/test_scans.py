"""Block scans equal the recursion row after row, wherever the blocks end."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scans
from tidemark.functions.semantics import smoothed
from tidemark.operators import books

DAY = dt.datetime(2024, 1, 1)


def close(a, b):
    return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-11, abs_tol=1e-11))


def smooth(values, n, alpha):
    out, seen, y, dead = [], [], None, False
    for v in values:
        dead = dead or (v is None and bool(seen))
        if dead:
            out.append(None)
            continue
        if v is not None:
            seen.append(v)
            y = alpha * v + (1 - alpha) * y if len(seen) > n else sum(seen) / n if len(seen) == n else None
        out.append(y)
    return out


@pytest.mark.parametrize("span", [1, 3, 7, 64, 1000])
def test_smoothers_whatever_the_blocks(spark, span):
    rng = random.Random(span)
    series = {"long": [rng.uniform(-5, 5) for _ in range(150)], "late": [None] * 40 + [rng.uniform(1, 2) for _ in range(60)], "hole": [1.0, 2.0, 3.0, 4.0, None, 6.0, 7.0, 8.0], "short": [1.0, 2.0], "none": [None] * 20, "early hole": [1.0, None, 3.0, 4.0, 5.0, 6.0]}
    rows = [(k, i, v, "kept") for k, s in series.items() for i, v in enumerate(s)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "symbol string, ts long, x double, other string").repartition(3)
    plans = {"a": ("x", 14, 1 / 14), "b": ("x", 3, 0.5), "c": ("x", 1, 1.0), "d": ("x", 50, 2 / 51)}
    got = {(r.symbol, r.ts): r for r in scans.smoothers(df, plans, span=span).collect()}
    assert len(got) == len(rows) and got["long", 0].other == "kept"
    for k, s in series.items():
        for name, (_, n, alpha) in plans.items():
            assert all(close(got[k, i][name], want) for i, want in enumerate(smooth(s, n, alpha))), (k, name)
    assert scans.smoothers(df.limit(0), plans).count() == 0


def test_one_bad_bar_leaves_other_symbols_alone(spark):
    df = spark.createDataFrame([(s, DAY + dt.timedelta(days=i), None if (s, i) == ("A", 5) else 1.0 * i) for s in "AB" for i in range(9)], "symbol string, ts timestamp_ntz, x double")
    out = {(r.symbol, r.ts.day): r.y for r in smoothed(df, {"y": ("x", 2, 0.5)}).collect()}
    assert [out["A", d] is None for d in range(1, 10)] == [True, False, False, False, False, True, True, True, True]
    assert all(out["B", d] is not None for d in range(2, 10))


def test_one_symbol_is_many_tasks(spark):
    """Each block of a long history is a group of its own: no group reads more than a block's rows."""
    rows = spark.range(60_000).select(F.lit("A").alias("symbol"), F.col("id").alias("ts"), (F.col("id") % 97).cast("double").alias("x"))
    seen = spark.sparkContext.accumulator(0)
    sizes = scans.smooth_block

    def counted(x, n, alpha, state):
        assert len(x) <= 1000
        seen.add(1)
        return sizes(x, n, alpha, state)

    scans.smooth_block = counted
    try:
        got = scans.smoothers(rows, {"y": ("x", 200, 2 / 201)}, span=1000).agg(F.count("y"), F.sum("y")).first()
    finally:
        scans.smooth_block = sizes
    want = [y for y in smooth([float(i % 97) for i in range(60_000)], 200, 2 / 201) if y is not None]
    assert got[0] == len(want) and math.isclose(got[1], sum(want), rel_tol=1e-10) and seen.value == 60


def fold(rows):
    y, was, out = 0.0, None, []
    for a, b in rows:
        was, y = y, b if a == 0 else None if None in (a, b, y) else a * y + b
        out.append((was, y))
    return out


@pytest.mark.parametrize("span", [1, 4, 1000])
def test_affine_maps_with_resets_and_nulls(spark, span):
    rng = random.Random(9)
    steps = [(rng.choice([0.0, 1.0, 0.5, -1.5]), rng.uniform(-9, 9)) for _ in range(80)]
    steps[20], steps[21], steps[40], steps[41] = (None, 1.0), (1.0, 1.0), (1.0, None), (0.0, None)
    df = spark.createDataFrame([("A", i // 2, i, a, b) for i, (a, b) in enumerate(steps)] + [("B", 0, 0, 1.0, 2.0)], "k string, ts long, seq int, a double, b double").repartition(4)
    got = sorted(scans.affine(df, {"y": ("a", "b")}, "k", order=("ts", "seq"), before="was_", span=span).where("k = 'A'").collect(), key=lambda r: r.seq)
    assert all(close(r.was_y, was) and close(r.y, y) for r, (was, y) in zip(got, fold(steps), strict=True))


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_intervals_one_after_the_other(spark, block):
    rng = random.Random(block)
    rows = []
    for k in "AB":
        at = 0
        while at < 600:
            at += rng.choice([1, 1, 1, 2, 9, 70])
            rows.append((k, at, at + rng.randint(0, 13)))
    want, free = set(), {}
    for k, a, z in rows:
        if a >= free.get(k, -1):
            want.add((k, a))
            free[k] = max(z, a + (z == a))
    got = scans.taken(spark.createDataFrame(rng.sample(rows, len(rows)), "k string, a long, z long").repartition(3), "a", "z", 13, "k", block=block)
    assert {(r.k, r.a) for r in got.collect()} == want and got.columns == ["k", "a", "z"]


def book(fills):
    """The netting rules, one fill after the other."""
    units, price, out = 0.0, None, []
    for u, p in fills:
        was, realized = units, 0.0
        if u == 0:
            action = "NONE"
        elif units == 0:
            units, price, action = u, p, "OPEN"
        elif units * u > 0:
            price, units, action = (price * units + p * u) / (units + u), units + u, "INCREASE"
        else:
            realized = min(abs(u), abs(units)) * (p - price) * (1 if units > 0 else -1)
            units += u
            action = "CLOSE" if units == 0 else "REDUCE" if units * was > 0 else "REVERSE"
            price = None if units == 0 else p if action == "REVERSE" else price
        out.append((action, was, units, price, realized))
    return out


def test_book_by_the_rules(spark):
    rng = random.Random(4)
    fills = {k: [(float(rng.choice([-3, -2, -1, 0, 1, 2, 3])), rng.uniform(5, 9)) for _ in range(60)] for k in "AB"}
    df = spark.createDataFrame([(k, DAY + dt.timedelta(days=40 * (i // 3)), i, u, p, 0.25) for k, f in fills.items() for i, (u, p) in enumerate(f)], "k string, ts timestamp_ntz, seq int, units double, price double, commission double")
    got = {(r.k, r.seq): r for r in books.netting_book(df, "k", order=("ts", "seq"), span=90).collect()}
    seen = set()
    for k, f in fills.items():
        for i, (action, was, now, price, realized) in enumerate(book(f)):
            r = got[k, i]
            assert (r.action, r.units_before, r.units_after) == (action, was, now) and close(r.avg_price, price) and close(r.realized, realized) and close(r.cash, realized - 0.25)
            seen.add(action)
    assert seen == {"NONE", "OPEN", "INCREASE", "REDUCE", "CLOSE", "REVERSE"}


def test_unknown_prices_and_rates(spark):
    fills = [(2.0, 5.0, 0.5), (1.0, None, 0.5), (-1.0, 9.0, 0.5), (-2.0, 9.0, 0.5), (-4.0, 7.0, 0.5), (4.0, 6.0, 0.5)]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(fills)], "ts int, units double, price double, rate double").withColumn("k", F.lit("A"))
    out = sorted(books.netting_book(df, "k", rate="rate").collect(), key=lambda r: r.ts)
    assert [r.avg_price for r in out] == [5.0, None, None, None, 7.0, None]
    assert [r.realized for r in out] == [0.0, 0.0, None, None, 0.0, 2.0]


def test_average_cost_and_sales_of_more_than_is_held(spark):
    fills = [("BUY", 10.0, 100.0, 1.0), ("BUY", 10.0, 140.0, 1.0), ("SELL", 5.0, 80.0, 0.5), ("SELL", 15.0, 150.0, 0.5), ("SELL", 1.0, 9.0, 0.5), ("BUY", 1.0, 9.0, 0.5), ("BUY", 2.0, 20.0, 0.5)]
    df = spark.createDataFrame([("A", i, *f) for i, f in enumerate(fills)], "k string, ts int, side string, shares double, notional double, costs double")
    out = sorted(books.average_cost(df, "k").collect(), key=lambda r: r.ts)
    assert [r.action for r in out] == ["ENTRY", "ADD", "REDUCE", "EXIT", "SHORT", "SHORT", "ENTRY"]
    assert [r.realized for r in out] == [0.0, 0.0, 80 - 60 - 0.5 - 0.5, 150 - 180 - 1.5 - 0.5, None, None, 0.0]
    assert [r.basis_notional for r in out] == [100.0, 240.0, 180.0, 0.0, None, None, 20.0]
