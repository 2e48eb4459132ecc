"""Order states, runs, decisions and accounts on small cases: nulls, ties, empty tables, the order of the rules."""

import datetime as dt

import pytest

from tidemark.functions.semantics import with_ranks, with_runs
from tidemark.operators import desk

NOW = dt.datetime(2024, 1, 9, 12)


def test_order_state_changes_on_some_events_only(spark):
    rows = [("a", 1, "note", "x", 1.0), ("b", 1, "submitted", "accepted", None), ("b", 2, "status", None, 5.0), ("b", 3, "note", "lost", None), ("c", 1, "submitted", "accepted", 1.0), ("c", 2, "failed", "filled", 2.0), (None, 1, None, None, None)]
    df = spark.createDataFrame(rows, "order_id string, seq int, event string, broker_status string, paid double")
    out = {r.order_id: (r.status, r.last_event, r.paid, r.n) for r in desk.order_state(df, "paid").collect()}
    assert out == {"a": ("intent", "note", 1.0, 1), "b": ("accepted", "note", 5.0, 3), "c": ("failed", "failed", 2.0, 2), None: ("intent", None, None, 1)}
    assert desk.order_state(df.limit(0), "paid").count() == 0


def test_stages_and_interrupted_runs(spark):
    df = spark.createDataFrame([(1, "stage", "x", 2.0), (1, "stage", "x", 4.0), (1, "run_finished", None, None), (2, "stage", "y", None)], "run_id int, event string, stage string, seconds double")
    out = {r.stage: (r.n, r.mean_seconds, r.max_seconds, r.runs, r.interrupted_runs) for r in desk.stage_seconds(df).collect()}
    assert out == {"x": (2, 3.0, 4.0, 2, 1), "y": (1, None, None, 2, 1)}


@pytest.mark.parametrize(
    "veto, position, owner, proposals, want",
    [
        (True, 5.0, "a", [("a", "CLOSE", 0, 1.0)], ("CLOSE", 0, 1.0, "a", "owner")),
        (True, -5.0, "a", [("b", "CLOSE", 0, 1.0), ("b", "OPEN", 1, 0.9)], ("HOLD", -1, 0.0, "a", "held")),
        (True, 0.0, None, [("a", "OPEN", 1, 0.9)], ("VETO", 0, 0.0, None, "veto")),
        (False, 0.0, None, [("a", "OPEN", 1, 0.9), ("b", "OPEN", -1, 0.7)], ("HOLD", 0, 0.0, None, "conflict")),
        (False, 0.0, None, [("a", "OPEN", 1, 0.7), ("b", "OPEN", -1, 0.5)], ("OPEN", 1, 0.7, "a", "signal")),
        (False, None, None, [("b", "OPEN", 1, 0.7), ("a", "OPEN", 1, 0.7)], ("OPEN", 1, 0.7, "a", "signal")),
        (False, 0.0, None, [("z", "OPEN", 1, 0.9)], ("HOLD", 0, 0.0, None, "watched")),
        (None, None, None, [], ("HOLD", 0, 0.0, None, "no_signal")),
    ],
)
def test_decisions_in_order_of_the_rules(spark, veto, position, owner, proposals, want):
    state = spark.createDataFrame([("s", NOW, veto, position, owner)], "symbol string, ts timestamp_ntz, veto boolean, position double, owner string")
    p = spark.createDataFrame([("s", NOW, *x) for x in proposals], "symbol string, ts timestamp_ntz, agent string, action string, dir int, score double")
    (r,) = desk.pair_decisions(state, p, ("a", "b"), 0.6).collect()
    assert (r.action, r.dir, r.score, r.agent, r.reason) == want


def test_marks_by_side_and_unknown_rates(spark):
    pos = spark.createDataFrame([("p", "EUR", "USD", 10.0, 1.0), ("q", "USD", "EUR", -10.0, 1.0), ("r", "XXX", "USD", 1.0, 1.0)], "pair string, base string, quote string, units double, avg_price double")
    quotes = spark.createDataFrame([("p", 1.1, 1.2), ("q", 0.8, 0.9)], "pair string, bid double, ask double")
    rates = spark.createDataFrame([("EUR", 1.0), ("USD", 0.5)], "ccy string, rate double")
    m = desk.marked(pos, quotes, rates, 10.0)
    out = {r.pair: r for r in m.collect()}
    assert (out["p"].mark, out["q"].mark, out["r"].mark) == (1.1, 0.9, None)
    assert out["p"].unrealized == pytest.approx(0.5) and out["q"].unrealized == pytest.approx(1.0) and out["q"].margin == 0.5 and out["r"].notional is None
    net = {r.ccy: r.net for r in desk.currency_exposure(m.where("pair <> 'r'")).collect()}
    assert net == {"EUR": 15.0, "USD": -15.0}


def test_ranks_do_not_hang_on_blocks(spark):
    values = [float(x) if x % 5 else None for x in [(i * 37) % 23 for i in range(60)]]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(values)] + [("B", 0, 1.0)], "symbol string, ts int, x double")
    got = {(r.symbol, r.ts): (r["__below"], r["__equal"], r["__count"]) for r in with_ranks(df, "x", 7, block=8).collect()}
    for i, v in enumerate(values):
        frame = [x for x in values[max(0, i - 7) : i] if x is not None]
        want = (None, None, len(frame)) if v is None else (sum(x < v for x in frame), frame.count(v), len(frame))
        assert got["A", i] == want
    assert got["B", 0] == (0, 0, 0) and len(got) == 61 and with_ranks(df.limit(0), "x", 7).count() == 0


def test_runs_of_nulls_and_values(spark):
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate([None, None, "x", "x", "y", None])], "symbol string, ts int, v string")
    assert [(r.run_id, r.run_age) for r in with_runs(df, "v").orderBy("ts").collect()] == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1)]
