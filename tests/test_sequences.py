"""Sequences equal a machine that steps through all bars of a symbol, wherever blocks end."""

import datetime as dt
import random
from statistics import median

import pytest

from tidemark.operators import sequences
from tidemark.operators.sequences import Course

START = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double"


def walk(n, seed, minutes=5, gaps=(), symbol="A", step=0.5):
    """A market that swings, so that ranges are swept and broken."""
    rng, price, rows, at = random.Random(seed), 100.0, [], START
    for i in range(n):
        at += dt.timedelta(minutes=minutes * (4 if i in gaps else 1)) if i else dt.timedelta(0)
        opened = price
        price += rng.gauss(0, step) - 0.02 * (price - 100)
        rows.append((symbol, at, opened, max(opened, price) + abs(rng.gauss(0, 0.2)), min(opened, price) - abs(rng.gauss(0, 0.2)), price))
    return rows


def floor_to(at, minutes):
    since = (at - dt.datetime(1970, 1, 1)) // dt.timedelta(minutes=minutes)
    return dt.datetime(1970, 1, 1) + since * dt.timedelta(minutes=minutes)


def ranges(rows, minutes, needed):
    held = {}
    for r in rows:
        held.setdefault(floor_to(r[1], minutes), []).append(r)
    return {k: (max(r[3] for r in v), min(r[4] for r in v), v[-1][5] < v[0][2]) for k, v in held.items() if len(v) == needed}


def machine(rows, sweeps, course, session=lambda i: 0, body=lambda i: None):
    """One pass with a state: sweeps[i] is the reference's low where bar i sweeps."""
    out, state = [], None
    for i, (_, at, o, h, lo, c) in enumerate(rows):
        if state:
            s = state
            zone = lambda: [s["base"] + p * (s["origin"] - s["base"]) for p in (0.62, 0.79)]  # noqa: B023, E731
            end = None
            if session(i) != session(s["i"]):
                end = "session"
            elif at - rows[i - 1][1] != s["step"]:
                end = "gap"
            elif i - s["i"] > course.horizon:
                end = "expired"
            elif h >= s["origin"]:
                end = "origin"
            elif course.floored and lo <= s["floor"]:
                end = "floor"
            elif s["broke"] is None:
                s["base"] = min(s["base"], lo)
                if c < s["level"] and c < o:
                    s["broke"] = s["lowest"] = i
                    s["displaced"] = body(i) is not None and o - c >= 1.25 * body(i)
                    s["gap"] = i >= 2 and h < rows[i - 2][4]
            elif lo < s["base"] and s["settled"]:
                end = "new_low"
            else:
                if lo < s["base"]:
                    s["base"], s["lowest"] = lo, i
                s["settled"] = s["settled"] or i - s["lowest"] >= course.settle
                s["gap"] = s["gap"] or h < rows[i - 2][4]
                a, z = zone()
                if s["settled"] and h >= a:
                    end = "retest" if h <= z and c < a and c < o and c > s["floor"] else "passed"
            if end:
                out.append((s["at"], end, at, s["origin"], s["base"], s["broke"], s["displaced"] and s["gap"]))
                state = None
        if state is None and i in sweeps:
            state = dict(i=i, at=at, origin=h, base=lo, level=min(r[4] for r in rows[i - 3 : i]), floor=sweeps[i], broke=None, lowest=None, settled=course.settle == 0, displaced=False, gap=False, step=dt.timedelta(minutes=5))
    if state:
        out.append((state["at"], "open", None, state["origin"], state["base"], state["broke"], False))
    return out


def swept(rows, hours=4):
    held = ranges(rows, hours * 60, hours * 12)
    out = {}
    for i, (_, at, _o, h, lo, c) in enumerate(rows):
        ref = held.get(floor_to(at, hours * 60) - dt.timedelta(hours=hours))
        if i >= 3 and ref and ref[2] and h > ref[0] and ref[1] < c < ref[0] and lo >= ref[1]:
            out[i] = ref[1]
    return out


@pytest.mark.parametrize("block", [14, 64, 4096])
def test_five_minute_machine(spark, monkeypatch, block):
    monkeypatch.setattr(sequences, "BLOCK", block)
    gaps = {700, 1500, 1501}
    rows = walk(3000, 4, gaps=gaps, step=1.2)
    other = walk(40, 8, symbol="B")
    df = spark.createDataFrame(random.Random(1).sample(rows + other, len(rows + other)), SCHEMA).repartition(3)
    got = sorted(sequences.sweep_retests(df).collect(), key=lambda r: r.swept_at)
    want = machine(rows, swept(rows), sequences.FAST)
    assert [(r.swept_at, r.outcome, r.ended_at, r.origin, r.base) for r in got] == [w[:5] for w in want]
    assert [r.broke_at for r in got] == [None if w[5] is None else rows[w[5]][1] for w in want]
    assert {"expired", "origin", "passed", "new_low"} <= {w[1] for w in want}  # retests: the next tests


def flat(n, low=99.0, high=101.0):
    return [[100.0, high, low, 100.0] for _ in range(n)]


def scene(after, before=48):
    """A fallen reference of 4 hours (101 to 99), three bars, a sweep to 102 and what follows."""
    bars = flat(before)
    bars[-1] = [100.0, 100.5, 99.0, 99.5]
    bars += [[100.0, 100.5, 99.6, 100.0]] * 3 + [[100.0, 102.0, 99.9, 100.5]] + after
    return [("A", START + dt.timedelta(minutes=5 * i), *map(float, b)) for i, b in enumerate(bars)]


QUIET, BREAK = [100.0, 100.2, 99.7, 100.0], [100.0, 100.2, 99.1, 99.5]


@pytest.mark.parametrize("course", [Course(8), Course(12), Course(36)])
def test_expiry_at_the_bar(spark, course):
    """A retest on the last bar counts, on the next one it has expired."""
    retest = [100.9, 101.0, 100.0, 100.2]
    for late, want in ((0, "retest"), (1, "expired")):
        after = [QUIET] * (course.horizon - 2 + late) + [BREAK, retest, QUIET]
        rows = scene(after)
        (r,) = sequences.sweep_retests(spark.createDataFrame(rows, SCHEMA), course=course).collect()
        assert r.outcome == want and r.ended_at == rows[51 + course.horizon + late][1]


def test_a_bar_that_ends_one_begins_the_next(spark):
    rows = scene([[100.5, 103.0, 99.9, 100.8], BREAK, [100.0, 100.1, 99.0, 100.0]])
    got = sorted(sequences.sweep_retests(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.swept_at)
    assert [(r.outcome, r.origin, r.swept_at) for r in got] == [("origin", 102.0, rows[51][1]), ("new_low", 103.0, rows[52][1])]
    assert sequences.sweep_retests(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


@pytest.mark.parametrize("block", [40, 4096])
def test_session_machine(spark, monkeypatch, block):
    monkeypatch.setattr(sequences, "BLOCK", block)
    rows = walk(288 * 12, 3, gaps={1000, 2000}, step=1.0)
    hours = {name: (a, z, b, y) for name, a, z, b, y in sequences.SESSIONS}
    held, session = {}, {}
    for i, (_, at, *_) in enumerate(rows):
        for name, (a, z, b, y) in hours.items():
            if a <= at.hour < z:
                held.setdefault((at.date() + dt.timedelta(days=1 if b == 0 else 0), name), []).append(rows[i])
            if b <= at.hour < y:
                session[i] = (at.date(), name)
    sweeps, aligned = {}, {}
    for i, (_, at, _o, h, lo, c) in enumerate(rows):
        ref = held.get(session.get(i), [])
        a, z = hours[session[i][1]][:2] if i in session else (0, 0)
        if ref and len(ref) == (z - a) * 12 and i >= 20:
            top, bottom = max(r[3] for r in ref), min(r[4] for r in ref)
            if h > top and bottom < c < top and lo > bottom and at - rows[i - 3][1] == dt.timedelta(minutes=15):
                sweeps[i] = bottom
                aligned[at] = rows[i - 1][5] < sum(r[5] for r in rows[i - 20 : i]) / 20
    body = lambda i: median(abs(r[5] - r[2]) for r in rows[i - 20 : i]) if i >= 20 else None
    want = machine(rows, sweeps, sequences.SESSION, session=session.get, body=body)
    got = sorted(sequences.session_setups(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect(), key=lambda r: r.swept_at)
    assert [(r.swept_at, r.outcome, r.ended_at, r.origin, r.base) for r in got] == [w[:5] for w in want] and len(want) > 15
    at = {r[1]: r for r in rows}
    for r, w in zip(got, want, strict=True):
        bar = at.get(w[2])
        strength = min(0.95, 0.5 + 0.4 * abs(bar[5] - bar[2]) / max(bar[3] - bar[4], 1e-12)) if w[1] == "retest" else None
        shown = (r.reversal, r.continuation, r.momentum)
        assert shown == (strength, strength if aligned[w[0]] else None, strength if w[6] else None) or shown == pytest.approx((strength, strength if aligned[w[0]] else None, strength if w[6] else None))
    assert "retest" in {w[1] for w in want}


def ready(rows):
    """The latest bar judged by all bars up to it, for every bar."""
    out = {}
    held = {}
    for t in range(len(rows)):
        frame = rows[: t + 1]
        held = ranges(frame, 240, 4)
        if t < 15 or frame[t][1] - frame[t - 15][1] != dt.timedelta(hours=15):
            continue
        for i in range(t - 1, max(3, t - 8) - 1, -1):
            _, at, _o, h, lo, c = frame[i]
            ref = held.get(floor_to(at, 240) - dt.timedelta(hours=4))
            if not (ref and ref[2] and h > ref[0] and ref[1] < c < ref[0] and lo >= ref[1]):
                continue
            level = min(r[4] for r in frame[i - 3 : i])
            j = next((j for j in range(i + 1, t) if frame[j][5] < min(level, frame[j][2])), None)
            if j is None:
                continue
            origin, base = max(r[3] for r in frame[i : j + 1]), min(r[4] for r in frame[i : j + 1])
            a, z = (base + p * (origin - base) for p in (0.62, 0.79))
            _, now, o, h, _lo, c = frame[t]
            if any(r[3] >= origin for r in frame[j + 1 :]) or any(r[4] < base for r in frame[j + 1 : t]):
                continue
            if a <= h <= z and c < a and c < o and ref[1] < c < ref[0]:
                out[now] = (at, frame[j][1], origin, base)
                break
    return out


@pytest.mark.parametrize("block", [9, 4096])
def test_hourly_readiness(spark, monkeypatch, block):
    monkeypatch.setattr(sequences, "BLOCK", block)
    rows, want = [], {}
    for k in range(3):
        mine = walk(400, 25 + k, minutes=60, gaps={300} if k else set(), symbol=f"S{k}", step=0.5)
        rows += mine
        want |= {(f"S{k}", t): w for t, w in ready(mine).items()}
    got = {(r.symbol, r.ts): (r.swept_at, r.broke_at, r.origin, r.base) for r in sequences.hourly_veto(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == want and len(want) >= 3
