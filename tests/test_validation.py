"""Scenarios, resampled comparisons, areas and timing against plain versions."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import statistics, validation

START = dt.datetime(2024, 1, 1)


def day(i):
    return START + dt.timedelta(days=i)


def test_scenarios_equal_a_walk_with_cash(spark):
    rng = random.Random(1)
    bars = [(s, day(i), *[100 + rng.gauss(0, 5) for _ in range(2)]) for s in "AB" for i in range(40)]
    asks = [(s, day(i), k, float(rng.random() < p)) for s in "AB" for i in range(40) for k, p in (("often", 0.5), ("never", 0.0))]
    scenarios = [("free", 0.0), ("dear", 50.0)]
    cube = validation.scenario_cube(
        spark.createDataFrame(asks, "symbol string, ts timestamp_ntz, strategy string, target double"), spark.createDataFrame(bars, "symbol string, ts timestamp_ntz, open double, close double"),
        spark.createDataFrame(scenarios, "scenario string, bps double"), F.when(F.dayofmonth("ts") <= 15, "first").otherwise("second"),
    )
    got = {(r.symbol, r.strategy, r.scenario, r["slice"]): r for r in cube.collect()}
    assert len(got) == 2 * 2 * 2 * 3
    for symbol in "AB":
        for strategy in ("often", "never"):
            for scenario, bps in scenarios:
                c, cash, shares, equity, orders, target = bps / 1e4, 1.0, 0.0, [1.0], [], 0.0
                mine = [b for b in bars if b[0] == symbol]
                want = [a[3] for a in asks if a[0] == symbol and a[2] == strategy]
                for i, (_, _, opened, closed) in enumerate(mine):
                    ask, traded = target, 0
                    if ask > 0 and shares == 0:
                        shares, cash, traded = cash / (opened * (1 + c)), 0.0, 1
                    elif ask == 0 and shares > 0:
                        cash, shares, traded = shares * opened * (1 - c), 0.0, 1
                    target = want[i]
                    orders.append(traded)
                    equity.append(cash + shares * closed)
                for name, chosen in (("full", range(40)), ("first", [i for i in range(40) if day(i).day <= 15]), ("second", [i for i in range(40) if day(i).day > 15])):
                    r = got[symbol, strategy, scenario, name]
                    moves = [equity[i + 1] / equity[i] for i in chosen]
                    level, top, fall = 1.0, 1.0, 0.0
                    for m in moves:
                        level *= m
                        top = max(top, level)
                        fall = min(fall, level / top - 1)
                    assert r.sessions == len(moves) and r.orders == sum(orders[i] for i in chosen)
                    assert math.isclose(r.log_growth, math.log(level), abs_tol=1e-9) and math.isclose(r.max_drawdown, fall, abs_tol=1e-9)
                    sd = np.std(np.array(moves) - 1, ddof=1)
                    assert (r.sharpe is None) == (sd == 0) and (sd == 0 or math.isclose(r.sharpe, (np.mean(moves) - 1) / sd * 252**0.5, rel_tol=1e-6))


def test_paired_resamples_share_their_positions(spark):
    rng = np.random.default_rng(3)
    series = {"a": rng.normal(0.001, 0.02, 120), "b": rng.normal(0.0, 0.01, 120), "c": np.zeros(120)}
    rows = [("k", day(i), s, float(v)) for s, x in series.items() for i, v in enumerate(x)] + [("k", day(500), "a", 0.5)]  # a session that the others lack
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, strategy string, daily_return double").repartition(3)
    got = {(r.first, r.second, r.metric): r for r in statistics.paired_bootstrap(df, "k", subject="strategy", resamples=600, block=7, seed=5).collect()}
    assert len(got) == 6 * 5
    at = statistics.block_positions(120, 600, 7, 5)
    drawn = {s: statistics.resampled_metrics(x[at], 252) for s, x in series.items()}
    whole = {s: statistics.resampled_metrics(x, 252) for s, x in series.items()}
    for (a, b, metric), r in got.items():
        samples = drawn[a][metric] - (drawn[b][metric] if b else 0)
        estimate = whole[a][metric] - (whole[b][metric] if b else 0)
        finite = samples[np.isfinite(samples)]
        assert r.finite == len(finite)
        if len(finite) and np.isfinite(estimate):
            assert (r.low, r.median, r.high) == pytest.approx(tuple(np.percentile(finite, [2.5, 50, 97.5]))) and r.estimate == pytest.approx(float(estimate))
            assert r.p_value == pytest.approx((1 + np.count_nonzero(abs(finite - estimate) >= abs(estimate))) / (len(finite) + 1))
        else:
            assert r.p_value is None and r.estimate is None
    chosen = statistics.paired_bootstrap(df, "k", subject="strategy", pairs=(("b", "a"), ("b", "zz")), resamples=20, metrics=("sharpe",)).collect()
    assert sorted((r.first, r.second) for r in chosen if r.second) == [("b", "a")]


def test_each_resample_has_its_own_seed():
    whole = statistics.block_positions(50, 40, 6, 9)
    assert (statistics.block_positions(50, 40, 6, 9, slice(3, None, 7)) == whole[3::7]).all() and whole.max() < 50 and (np.diff(whole[:, :6]) == 1).all()


def auc(y, p):
    pairs = [(a, b) for a, x in zip(p, y, strict=True) if x == 1 for b, z in zip(p, y, strict=True) if z == 0]
    return sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs) if pairs else None


def test_areas_with_ties_and_one_class(spark):
    rng = random.Random(2)
    rows = {"tied": [(rng.randint(0, 1), rng.choice([0.1, 0.2, 0.3])) for _ in range(40)], "one": [(1, rng.random()) for _ in range(12)], "rare": [(int(i == 5), rng.random()) for i in range(30)]}
    df = spark.createDataFrame([(k, day(i), y, p) for k, r in rows.items() for i, (y, p) in enumerate(r)] + [("tied", day(99), None, 0.5), ("tied", day(98), 1, None), ("tied", day(97), 1, float("nan"))], "k string, ts timestamp_ntz, y int, p double")
    got = {r.k: r for r in validation.auc_interval(df.repartition(3), "k", resamples=500, block=4, seed=3).collect()}
    for k, r in rows.items():
        y, p = zip(*r, strict=True)
        samples = [auc([y[i] for i in at], [p[i] for i in at]) for at in statistics.block_positions(len(y), 500, 4, 3).tolist()]
        known = [s for s in samples if s is not None]
        assert got[k].n == len(y) and got[k].valid == len(known)
        assert got[k].auc == (None if auc(y, p) is None else pytest.approx(auc(y, p)))
        if known:
            assert (got[k].low, got[k].high) == pytest.approx(tuple(np.percentile(known, [2.5, 97.5])))
    assert got["one"].low is None and 0 < got["rare"].valid < 500


def test_random_bars_are_drawn_without_replacement(spark):
    rng = random.Random(4)
    outcomes = {(s, i, d): (rng.randint(1, 5), rng.uniform(-1, 2)) for s in "AB" for i in range(50) for d in (-1, 1) if not (i == 7 and d == 1)}
    picked = [("A", i, -1) for i in (1, 3, 7, 20, 22, 40)] + [("B", 5, 1)]
    frame = spark.createDataFrame([(*k, *v) for k, v in outcomes.items()], "symbol string, i long, dir int, bars long, net_r double")
    trades = validation.random_timing(frame, spark.createDataFrame(picked, "symbol string, i long, dir int"), reps=8)
    got = {(r.rep, r.symbol): (r.trades, r.sum_r) for r in trades.collect()}
    allowed = {s: [i for i in range(50) if i != 7] for s in "AB"}
    real = {s: [(i, d) for t, i, d in picked if t == s and i != 7] for s in "AB"}
    for rep in range(-1, 8):
        for s in "AB":
            if rep < 0:
                bars = real[s]
            else:
                keyed = sorted((hashlib.md5(f"11|{rep}|{s}|{i}".encode()).hexdigest(), i) for i in allowed[s])[: len(real[s])]
                bars = sorted((i, -1 if h[31] in "01234567" else 1) for h, i in keyed)
            free, n, total = -1, 0, 0.0
            for i, d in bars:
                if i >= free:
                    length, r = outcomes[s, i, d]
                    free, n, total = i + length, n + 1, total + r
            assert got[rep, s] == (n, pytest.approx(total))
    p = validation.timing_p(trades).first()
    means = [sum(got[k, s][1] for s in "AB") / sum(got[k, s][0] for s in "AB") for k in range(-1, 8)]
    assert p.p == pytest.approx((1 + sum(m >= means[0] for m in means[1:])) / 9) and p.reps == 8 and p.mean == pytest.approx(means[0])


GOOD = dict(cagr=0.1, cash_cagr=0.02, sharpe=0.5, max_drawdown=0.1, double_return=0.2, parts=[0.1, 0.0, 0.2, -0.1], profits=[1.0, 1.0, 1.0, -5.0], benchmark_sharpe=0.4, benchmark_drawdown=0.2)


@pytest.mark.parametrize(
    "change, failed",
    [
        ({}, None), ({"cagr": 0.02}, "gate_cash"), ({"cagr": None}, "gate_cash"), ({"sharpe": 0.39, "benchmark_sharpe": 0.1}, "gate_sharpe"), ({"benchmark_sharpe": 0.5}, "gate_sharpe"), ({"max_drawdown": 0.2}, "gate_drawdown"),
        ({"double_return": 0.0}, "gate_costs"), ({"parts": [0.1, -0.1, -0.1, 0.2]}, "gate_parts"), ({"profits": [3.0, 1.0, 1.0]}, "gate_spread"), ({"profits": [-1.0]}, "gate_spread"),
    ],
)
def test_gates(spark, change, failed):
    row = GOOD | change
    names = ("cagr", "cash_cagr", "sharpe", "max_drawdown", "double_return", "benchmark_sharpe", "benchmark_drawdown")
    df = spark.createDataFrame([(*[row[n] for n in names], row["parts"], row["profits"])], ", ".join(f"{n} double" for n in names) + ", parts array<double>, profits array<double>")
    r = validation.gates(df).first()
    assert r.passed == (failed is None) and [k for k in r.asDict() if k.startswith("gate_") and not r[k]] == ([failed] if failed else [])


def test_verdicts_and_status(spark):
    df = spark.createDataFrame([(True, 0.1, False), (True, -0.1, False), (True, None, False), (False, 0.1, False), (True, 0.1, True)], "p boolean, l double, f boolean")
    assert [r.v for r in df.select(validation.verdict(F.col("p"), F.col("l"), F.col("f")).alias("v")).collect()] == ["EDGE", "INSUFFICIENT", "INSUFFICIENT", "NO EDGE", "INSUFFICIENT"]
    tests = spark.createDataFrame([("k", "a", "hold", "sharpe", 0.5, 0.01), ("k", "b", "hold", "sharpe", -0.5, 0.01), ("k", "c", "hold", "sharpe", 0.5, 0.05), ("k", "d", "hold", "sharpe", 0.5, None), ("j", "a", "x", "sharpe", 0.5, 0.01)], "k string, first string, second string, metric string, estimate double, p_holm double")
    assert [r.status[:15] for r in validation.formal_status(tests).collect()] == ["significant at ", "significant at ", "not significant", "undefined (insu", "significant at "]
    assert {r.k: (r.edge, r.better) for r in validation.conclusion(tests, "hold", ("a", "b", "c", "d"), "k").collect()} == {"k": (True, "a (sharpe)"), "j": (False, "")}
