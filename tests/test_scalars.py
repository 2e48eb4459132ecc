"""Scalar rules on hand cases."""

import datetime as dt
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar, scalars
from tidemark.operators import ledger


def values(spark, column, *xs, kind="double"):
    return [r.v for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}").select("i", column.alias("v")).orderBy("i").collect()]


def test_scores(spark):
    x = F.col("x")
    assert values(spark, scalars.at_least(x, 0.2, 0.6), 0.1, 0.2, 0.4, 0.9, None) == [0.0, 0.0, pytest.approx(0.5), 1.0, None]
    assert values(spark, scalars.at_most(x, 0.6, 0.2), 0.9, 0.6, 0.4, 0.1, None) == [0.0, 0.0, pytest.approx(0.5), 1.0, None]
    assert values(spark, scalars.log_score(x, 4.0), 0.5, 1.0, 2.0, 9.0, 0.0, None) == [0.0, 0.0, pytest.approx(0.5), 1.0, None, None]
    assert values(spark, scalars.mean_of(x, F.lit(2.0), F.lit(float("nan"))), 4.0, None) == [3.0, 2.0]
    assert values(spark, scalars.mean_of(x, x), None, 1.0) == [None, 1.0]


def test_canonical_texts(spark):
    text = scalars.canonical({"b": F.col("x"), "a": F.lit("q\"}\\é"), "c": F.lit(None).cast("boolean")})
    got = values(spark, text, 5, None, kind="long")
    assert got[0] == json.dumps({"a": 'q"}\\é', "b": 5, "c": None}, separators=(",", ":"), ensure_ascii=False) and json.loads(got[1]) == {"a": 'q"}\\é', "b": None, "c": None}
    assert values(spark, scalars.fingerprint_of(F.lit("x"), 12), 1.0) == [hashlib.sha256(b"x").hexdigest()[:12]]


def test_costs_and_weights(spark):
    x = F.col("x")
    assert values(spark, scalars.commission(x, 0.01, 5.0, 25.0), 100.0, 1000.0, 9000.0, None) == [5.0, 10.0, 25.0, None]
    assert [float(v) if v is not None else None for v in values(spark, scalars.limit_price(F.lit(100.0), x), 3.0, 7.0, 0.0, None)] == [33.33, 14.28, None, None]
    assert values(spark, scalars.target_weight(4, 0.1, x), 0.05, 0.2, 0.0, None) == [0.25, 0.125, None, None]
    assert values(spark, scalars.state_of(x), 0.5, 0.51, float("nan"), None) == ["FLAT", "LONG", "INSUFFICIENT_DATA", "INSUFFICIENT_DATA"]
    assert values(spark, scalars.without_nan(x), 1.0, float("nan"), None) == [1.0, None, None]


def test_times_in_several_notations(spark):
    got = values(spark, scalars.iso_time(F.col("x")).cast("string"), "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.25", "2024-01-02 03:04:05", "2024-01-02T05:04:05+02:00", "soon", None, kind="string")
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:05.25", "2024-01-02 03:04:05", "2024-01-02 03:04:05", None, None]


def test_day_bounds_over_summer_time_and_holidays(spark):
    at = [dt.datetime(2024, 3, 8, 12), dt.datetime(2024, 3, 9, 12), dt.datetime(2024, 3, 11, 12), dt.datetime(2024, 7, 4, 12)]
    out = {r.ts: r for r in calendar.day_bounds(spark.createDataFrame([(t,) for t in at], "ts timestamp_ntz"), spark.createDataFrame([(dt.date(2024, 7, 4),)], "day date")).collect()}
    friday, saturday, monday, holiday = (out[t] for t in at)
    assert (friday.starts_at, friday.ends_at, friday.open, friday.next_open) == (dt.datetime(2024, 3, 7, 22), dt.datetime(2024, 3, 8, 22), True, at[0])
    assert not saturday.open and saturday.next_open == dt.datetime(2024, 3, 10, 21)  # Sunday 17:00, already summer time
    assert (monday.starts_at, monday.ends_at) == (dt.datetime(2024, 3, 10, 21), dt.datetime(2024, 3, 11, 21))
    assert not holiday.open and holiday.next_open == dt.datetime(2024, 7, 4, 21)


def test_fingerprints_do_not_hang_on_the_order_of_rows(spark):
    rows = [(k, f"m{i // 4}", f"{i:02}", str(i * 7 % 5)) for k in "ab" for i in range(12)]
    schema = "k string, m string, o string, v string"
    of = lambda r: {x.k: (x.rows, x.fingerprint) for x in ledger.block_fingerprint(spark.createDataFrame(r, schema), ("k",), "m", ("o",), ("v",)).collect()}
    whole = of(rows)
    assert whole == of(rows[::-1]) and whole["a"] == whole["b"]
    assert of([(*r[:3], "9") if r[0] == "a" and r[2] == "05" else r for r in rows])["a"] != whole["a"]
    block = lambda n: hashlib.sha256("".join(hashlib.sha256(f"{i:02}|{i * 7 % 5}".encode()).hexdigest() for i in range(4 * n, 4 * n + 4)).encode()).hexdigest()
    assert whole["a"] == (12, hashlib.sha256("".join(block(n) for n in range(3)).encode()).hexdigest()) and math.isfinite(whole["a"][0])
