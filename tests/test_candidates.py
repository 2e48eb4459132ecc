"""Retirement, cash and economic features on hand cases."""

import datetime as dt

import pytest

from tidemark.operators import candidates, labels

START = dt.datetime(2024, 1, 1)


def test_retirement_by_drawdown_and_by_weakness(spark):
    runs = {"fell": [3.0, 2.0, -5.0], "near": [3.0, 2.0, -4.9], "weak": [-0.3, 0.1] * 10, "few": [-0.3, 0.1] * 9, "old": [-4.0] + [0.1] * 60, "won": [1.0], "loss": [-5.0]}
    trades = spark.createDataFrame([(k, START + dt.timedelta(hours=i), x) for k, r in runs.items() for i, x in enumerate(r)], "candidate string, ts timestamp_ntz, net_r double").repartition(3)
    ranking = spark.createDataFrame([("loss", 1, True, False), ("busy", 2, True, True), ("bad", 3, False, False), ("next", 4, True, False), ("last", 5, True, False)], "candidate string, place int, eligible boolean, active boolean")
    out = {r.candidate: r for r in candidates.retirement(trades, ranking).collect()}
    assert {k: r.reason for k, r in out.items()} == {"fell": "drawdown", "near": "continue", "weak": "weak", "few": "continue", "old": "continue", "won": "continue", "loss": "drawdown"}
    assert all(r.replacement == ("next" if r.retire else None) for r in out.values())  # the first by place has itself retired
    assert out["fell"].drawdown_r == 5.0 and out["won"].profit_factor is None and out["won"].drawdown_r == 0.0
    assert out["old"].recent_mean == pytest.approx(0.1) and out["weak"].profit_factor == pytest.approx(1 / 3)
    nobody = candidates.retirement(trades, ranking.where("active")).where("candidate = 'fell'").first()
    assert nobody.retire and nobody.replacement is None and candidates.retirement(trades.limit(0), ranking).count() == 0


def test_cash_by_currency(spark):
    schema = "exec_id string, base string, quote string, units double, price double, fee double, fee_ccy string"
    fills = [("1", "EUR", "USD", 100.0, 1.1, 2.0, "USD"), ("1", "EUR", "USD", 100.0, 1.1, 2.0, "USD"), ("2", "USD", "JPY", -10.0, 150.0, 1.0, "USD"), ("3", "GBP", "USD", 1.0, 1.2, 0.0, "USD"), ("3", "GBP", "USD", 2.0, 1.2, 0.0, "USD")]
    money = lambda *r: spark.createDataFrame(list(r), "ccy string, amount double")
    out = {r.ccy: r for r in candidates.reconciled(spark.createDataFrame(fills, schema), money(("EUR", 5.0), ("SEK", 1.0)), money(("EUR", 105.004), ("JPY", 1500.4), ("CHF", 0.001))).collect()}
    assert {k: (round(r.expected, 6), r.corrections, r.agrees) for k, r in out.items()} == {
        "EUR": (105.0, 0, True), "USD": (-126.6, 1, False), "JPY": (1500.0, 0, True), "GBP": (3.0, 1, False), "SEK": (1.0, 0, False), "CHF": (0.0, 0, True),
    }


def test_what_a_position_would_cost(spark):
    rows = [("A", 1, 100.0, 100.2, 0.5), ("A", 2, 100.0, 100.2, None), ("A", 3, 100.0, 100.2, 0.0)]
    rules = labels.Barriers(capital=100_000.0, unit_step=1.0)
    a, b, c = sorted(labels.economic(spark.createDataFrame(rows, "symbol string, ts int, bid_close double, ask_close double, atr double"), rules).collect(), key=lambda r: r.ts)
    assert (a.spread_r, a.units_share) == pytest.approx((0.2, 0.02)) and a.fee_r == pytest.approx(2 * 2.0 / 100)
    assert (b.fee_r, b.spread_r, b.floor_ratio, b.units_share) == (None,) * 4
    assert c.floor_ratio == 0.0 and c.units_share == 1.0 and c.fee_r > 0
