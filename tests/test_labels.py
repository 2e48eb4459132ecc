"""Labels equal a search bar by bar, weights a count bar by bar; few nodes are read for each label."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scans
from tidemark.operators import labels

START = dt.datetime(2024, 1, 2)
RULES = labels.Barriers(horizon=12, stop_atr=1.5, capital=1e6, unit_step=1.0, max_units=1e4)


def market(n, seed, symbol="A", gaps=()):
    rng, price, rows, at = random.Random(seed), 100.0, [], START
    for i in range(n):
        at += dt.timedelta(minutes=5 if i not in gaps else 65)
        opened = price + rng.choice([0, 0, 0, rng.gauss(0, 1.5)])
        price = opened + rng.gauss(0, 0.5)
        high, low = max(opened, price) + abs(rng.gauss(0, 0.3)), min(opened, price) - abs(rng.gauss(0, 0.3))
        rows.append((symbol, at, *[x - 0.01 for x in (opened, high, low, price)], *[x + 0.01 for x in (opened, high, low, price)], None if i < 3 else 0.8 + 0.1 * (i % 4)))
    return rows


SCHEMA = "symbol string, ts timestamp_ntz, " + ", ".join(f"{s}_{c} double" for s in ("bid", "ask") for c in ("open", "high", "low", "close")) + ", atr double"


def ordinal(at):
    """Trading days begin at 17:00 in New York, which is 22:00 UTC in January."""
    return (at + dt.timedelta(hours=2)).toordinal()


def plain(rows, direction, r=RULES):
    out = {}
    for i, row in enumerate(rows):
        symbol, ts, *prices, atr = row
        mine = rows[i : i + r.horizon + 1]
        end = mine[r.horizon][1] + dt.timedelta(minutes=5) if len(mine) > r.horizon else None
        out[symbol, ts] = (end, None, None, None)
        if end is None or end - ts != dt.timedelta(minutes=5 * (r.horizon + 1)) or atr is None:
            continue
        entry = mine[1][2] if direction < 0 else mine[1][6]
        risk = max(r.stop_atr * atr, 2 * r.least_commission / r.max_fee_risk / r.max_units)
        units = math.floor(min(r.capital * r.risk_percent / 100 / risk, r.max_units) / r.unit_step) * r.unit_step
        fee = lambda p: max(r.least_commission, r.commission * 1e-4 * units * p)
        if units < r.unit_step or 2 * fee(entry) / (units * risk) > r.max_fee_risk + 1e-9:
            continue
        for age in range(1, r.horizon + 1):
            o, hi, lo, cl = mine[age][6:10] if direction < 0 else mine[age][2:6]
            stop, goal = entry - direction * risk, entry + direction * r.reward * risk
            worst, best = (lo, hi) if direction > 0 else (hi, lo)
            d = direction
            if d * o <= d * stop:
                found = ("stop_gap", o)
            elif d * o >= d * goal:
                found = ("target_gap", o)
            elif d * worst <= d * stop:
                found = ("stop", stop)
            elif d * best >= d * goal:
                found = ("target", goal)
            else:
                found = ("time", cl)
                if age < r.horizon:
                    continue
            break
        nights = max(0, ordinal(mine[age][1]) - ordinal(mine[1][1]))
        cost = fee(entry) + fee(found[1]) + nights * r.financing * 1e-4 * units * entry
        out[symbol, ts] = (end, found[0], age, direction * (found[1] - entry) / risk - cost / (units * risk))
    return out


@pytest.mark.parametrize("direction", [-1, 1])
@pytest.mark.parametrize("block", [13, 50, 4096])
def test_labels_bar_by_bar(spark, direction, block):
    one, two = market(400, 1, gaps={100, 101, 320}), market(9, 2, "B")
    want = plain(one, direction) | plain(two, direction)
    df = spark.createDataFrame(random.Random(3).sample(one + two, len(one + two)), SCHEMA).repartition(3)
    got = {(r.symbol, r.ts): r for r in labels.barrier_labels(df, direction, RULES, block).collect()}
    assert got.keys() == want.keys()
    for k, (end, reason, age, net) in want.items():
        r = got[k]
        assert (r.label_end, r.reason, r.bars) == (end, reason, age) and (net is None) == (r.net_r is None) and (net is None or math.isclose(net, r.net_r, abs_tol=1e-9))
    assert {w[1] for w in want.values()} == {None, "stop_gap", "target_gap", "stop", "target", "time"}
    assert labels.barrier_labels(df.limit(0), direction, RULES).count() == 0


def test_few_nodes_are_read(monkeypatch):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(0, 1, 5000))
    start = np.arange(4800)
    tree = labels.Pyramid(x - 0.5, x + 0.5)
    found = tree.first(start, start + 96, x[start] - 12, x[start] + 24)
    plain = [next((j for j in range(i, i + 96) if x[j] - 0.5 <= x[i] - 12 or x[j] + 0.5 >= x[i] + 24), -1) for i in start]
    assert found.tolist() == plain
    assert tree.read.max() <= 3 * labels.FAN * labels.LEVELS and tree.read.mean() < 16  # of 96 bars


def test_flat_bars_nulls_and_sizes_that_forbid(spark):
    rows = [("A", START + dt.timedelta(minutes=5 * i), *[None if i == 5 else 50.0] * 4, *[50.0] * 4, 0.0 if i < 20 else 0.5) for i in range(40)]
    out = sorted(labels.barrier_labels(spark.createDataFrame(rows, SCHEMA), 1, RULES).collect(), key=lambda r: r.ts)
    assert len(out) == 40 and all(r.net_r is None for r in out[:20])  # without ranges the fee exceeds the risk
    assert all(r.reason == "time" for r in out[20:27]) and all(r.label_end is None for r in out[28:])


def test_forward_rows_and_purging(spark):
    rows = [("A", START + dt.timedelta(minutes=5 * (i + (60 if i >= 30 else 0))), float(i), float(i) + 0.5, [2.0, 0.0, None, 0.01][i % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, close double, atr double")
    out = sorted(labels.forward_rows(df, 4).collect(), key=lambda r: r.ts)
    for i, r in enumerate(out):
        known = i % 4 in (0, 3) and i + 4 < 60 and not 26 <= i < 30
        assert (r.target is not None) == known, i
        if known:
            assert r.target == (1.75 if i % 4 == 0 else 20.0)  # (i + 4.5 - (i + 1)) / atr within 20
    cut = F.lit(START + dt.timedelta(hours=30)).cast("timestamp_ntz")
    kept = [r.ts for r in labels.forward_rows(df, 4).where(labels.purged(F.lit(0), F.lit(START).cast("timestamp_ntz"), cut)).collect()]
    assert kept and max(kept) + dt.timedelta(minutes=25) < START + dt.timedelta(hours=6)


def test_rows_clear_of_windows(spark):
    hour = dt.timedelta(hours=1)
    rows = [("A", START + i * hour, START + (i + 3) * hour) for i in range(0, 240, 5)]
    windows = [(1, START + 50 * hour, START + 60 * hour), (2, START + 200 * hour, START + 201 * hour)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, label_end timestamp_ntz")
    got = {(r.ts, r.window) for r in labels.clear_of(df, spark.createDataFrame(windows, "window int, begin timestamp_ntz, end timestamp_ntz"), 12.0).collect()}
    want = {(a, w) for _, a, z in rows for w, b, e in windows if z <= b - 12 * hour or a >= e + 12 * hour}
    assert got == want and 0 < len(want) < 2 * len(rows)


def test_uniqueness_bar_by_bar(spark):
    rng = random.Random(5)
    bars = [(s, START + dt.timedelta(minutes=5 * i)) for s in "AB" for i in range(60)]
    chosen = {(s, i): (rng.randint(1, 12), rng.uniform(1, 2)) for s in "AB" for i in rng.sample(range(45), 20)}
    rows = [(s, START + dt.timedelta(minutes=5 * i), START + dt.timedelta(minutes=5 * (i + n)), w) for (s, i), (n, w) in chosen.items()]
    got = labels.uniqueness(spark.createDataFrame(bars, "symbol string, ts timestamp_ntz"), spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, label_end timestamp_ntz, weight double")).collect()
    covering = lambda s, j: sum(1 for (t, i), (n, _) in chosen.items() if t == s and i <= j < i + n)
    want = {(s, START + dt.timedelta(minutes=5 * i)): (sum(1 / covering(s, j) for j in range(i, i + n)) / n, w) for (s, i), (n, w) in chosen.items()}
    mean = sum(u for u, _ in want.values()) / len(want)
    assert len(got) == len(want)
    for r in got:
        u, w = want[r.symbol, r.ts]
        assert math.isclose(r.uniqueness, u, rel_tol=1e-9) and math.isclose(r.weight, w * u / mean, rel_tol=1e-9)


def test_blocks_with_their_surroundings(spark):
    df = scans.haloed(spark.range(20), "id", 5, before=2, after=1)
    got = {b: sorted((r.id, r["__own"]) for r in df.where(F.col("__block") == b).collect()) for b in (0, 1, 3)}
    assert [i for i, _ in got[0]] == [0, 1, 2, 3, 4, 5] and [i for i, _ in got[1]] == [3, 4, 5, 6, 7, 8, 9, 10]
    assert [i for i, own in got[3] if own] == [15, 16, 17, 18, 19]
    with pytest.raises(ValueError):
        scans.haloed(spark.range(3), "id", 2, after=3)
