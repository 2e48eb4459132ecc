"""Steps whose work must grow no faster than their input: their plans, and their results against plain versions."""

import contextlib
import datetime as dt
import io
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scans
from tidemark.functions.semantics import correlation, rounded
from tidemark.operators import books, contracts, features, ingestion, quality, trees
from tidemark.plans import portfolio_queries, registry, tree_queries
from tidemark.sources.bars import BAR_SCHEMA, item_bars

DAY = dt.datetime(2024, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain()
    return said.getvalue()


def test_gaps_need_no_product_of_instruments_and_sessions(spark):
    rng = random.Random(5)
    calendar = sorted(rng.sample(range(60), 35))
    held = [(s, rng.randrange(60)) for s in "abcdef" for _ in range(12)] + [("one", 7), (None, 3), ("a", None)]
    bars = spark.createDataFrame([(s, None if d is None else day(d)) for s, d in held * 2], "symbol string, ts timestamp_ntz").repartition(3)
    sessions = spark.createDataFrame([(day(d),) for d in calendar], "ts timestamp_ntz")
    want = set()
    for s in {s for s, _ in held}:
        mine = {d for k, d in held if k == s and d is not None}
        want |= {(s, day(d)) for d in calendar if min(mine) < d < max(mine) and d not in mine}
    found = quality.missing_sessions(bars, sessions)
    assert sorted((r.symbol, r.ts) for r in found.collect()) == sorted(want)
    runs = quality.gaps(bars, sessions)
    assert runs.agg(F.sum("n")).first()[0] == len(want)
    assert {(r.symbol, r.first) for r in runs.select("symbol", "first").collect()} <= want
    assert all(x not in plan(found) for x in ("NestedLoop", "Cartesian"))
    assert quality.missing_sessions(bars, sessions.limit(0)).count() == quality.missing_sessions(bars.limit(0), sessions).count() == 0


def test_engine_contract_counts_without_sorting_a_symbol(spark):
    rows = [("a", day(i % 4) if i % 7 else None, 1.0, 2.0, 0.5, 1.0) for i in range(20)] + [("a", day(9), -1.0, 2.0, 0.5, 1.0), ("b", day(0), 1.0, 0.9, 0.5, 1.0), ("c", None, None, 1.0, 1.0, 1.0)]
    found = contracts.engine_contract(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double"))
    assert {r.symbol: tuple(r)[1:] for r in found.collect()} == {"a": (21, 13, 1, 1), "b": (1, 0, 0, 1), "c": (1, 0, 1, 0)}
    assert "Window" not in plan(found)


def test_pairs_of_strategies_read_their_equity_once(spark):
    rows = [(s, day(d), k, float(d % 2), d / 10) for s in ("x", None) for d in range(3) for k in "cab"]
    e = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, strategy string, position double, daily_return double")
    found = portfolio_queries._pairs(e.where("not (strategy = 'b' and daily_return > 0.15)"))
    got = sorted((r.symbol, r.a.strategy, r.b.strategy, r.a.daily_return) for r in found.collect())
    assert got == sorted([("x", p, q, d / 10) for d in range(3) for p, q in ("ab", "ac", "bc") if not (d == 2 and "b" in p + q)])
    assert "Join" not in plan(found)


@pytest.mark.parametrize("name", ["agg_12_redundancy", "topk_05_importances"])
def test_series_that_do_not_vary_have_no_correlation(spark, tmp_path, name):
    """A strategy that never trades has constant returns, and constant prices have constant features: before, a division by zero."""
    con = duckdb.connect()
    lines = f"SELECT * {'REPLACE (100.0 * l_quantity AS l_extendedprice)' if name.startswith('topk') else ''} FROM '/root/testdata/sf0.001/lineitem.parquet'"
    con.execute(f"COPY ({lines} WHERE l_shipdate < '1995-12-01') TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    cursor = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})")
    got, want = (sorted(repr(tuple(r)) for r in rows) for rows in (df.collect(), cursor.fetchall()))
    assert got == want and any("nan" in r for r in got)


def test_correlation_of_pairs(spark):
    rows = [("two", 1.0, 2.0), ("two", 2.0, 4.0), ("two", None, 9.0), ("one", 1.0, 1.0), ("one", None, 2.0), ("none", None, 1.0), ("even", 0.1, 1.0), ("even", 0.1, 2.0), ("even", 0.7, None)]
    found = spark.createDataFrame(rows, "k string, x double, y double").groupBy("k").agg(correlation("x", "y").alias("v"))
    assert {r.k: str(r.v) for r in found.withColumn("v", F.round("v", 9)).collect()} == {"two": "1.0", "one": "nan", "none": "None", "even": "nan"}


def test_blocks_are_dealt_to_few_groups(spark, monkeypatch):
    """Small blocks share a Python call, whatever their number; what a block gives does not hang on its company."""
    rng = random.Random(2)
    rows = [(k if k else None, day(rng.randrange(400)), rng.random(), rng.random()) for k in range(40) for _ in range(rng.randrange(1, 30))]
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, a double, b double").dropDuplicates(["k", "ts"])
    found = {}
    for deals in (1, 16):
        monkeypatch.setattr(scans, "DEALT", deals)
        out = scans.affine(df, {"y": ("a", "b")}, "k", before="was_", span=50)
        assert "hashpartitioning(__deal" in plan(out)
        found[deals] = {(r.k, r.ts): (r.y, r.was_y) for r in out.collect()}
    assert found[1] == found[16]
    for k in {r[0] for r in rows}:
        y = 0.0
        for r in sorted(df.where(F.col("k").eqNullSafe(k)).collect(), key=lambda r: r.ts):
            was, y = y, r.a * y + r.b
            assert abs(found[1][k, r.ts][0] - y) < 1e-9 and abs(found[1][k, r.ts][1] - was) < 1e-9


def test_books_shuffle_their_fills_once(spark):
    """Units and costs run in one scan; before, each had its own, and each shuffled the fills twice."""
    fills = spark.createDataFrame([(1, day(i), "BUY" if i % 3 else "SELL", 2.0 if i % 3 else 1.0, 10.0 + i, 0.1) for i in range(1, 20)], "k long, ts timestamp_ntz, side string, shares double, notional double, costs double")
    for book in (books.average_cost(fills, "k"), books.netting_book(fills.select("k", "ts", F.col("shares").alias("units"), F.col("notional").alias("price")), "k")):
        assert plan(book).count("FlatMapGroupsInArrow") == 1


def test_duplicates_travel_without_a_text_of_their_values(spark):
    row = lambda symbol, *v: (symbol, day(0), *v)
    nan = float("nan")
    rows = [row("a", 1.0, None, 0.0, nan, 1.0, None)] * 2 + [row("b", 1.0, None, 0.0, 1.0, 1.0, 1.0), row("b", 1.0, 1.0, 0.0, 1.0, 1.0, 1.0)] + [row("c", 1.0, 1.0, 0.0, 1.0, 1.0, None), row("c", 1.0, 1.0, -0.0, 1.0, 1.0, None)] + [row("d", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    found = quality.duplicates(spark.createDataFrame(rows, BAR_SCHEMA))
    assert sorted((r.symbol, r.duplicate or "") for r in found.collect()) == [("a", ""), ("a", "duplicate_bar"), ("b", "conflicting_duplicate_bar"), ("b", "conflicting_duplicate_bar"), ("c", ""), ("c", "duplicate_bar"), ("d", "")]
    assert "to_json" not in plan(found)


def test_summary_of_a_run_takes_rows_as_they_came(spark):
    """Excluded rows are counted from the findings, so that rows are not validated once more."""
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "symbol string")
    merged = spark.createDataFrame([("inserted", False)], "change string, ignored boolean")
    found = spark.createDataFrame([("null_value", "excluded"), ("null_value", "excluded"), ("bar_revised", "updated")], "check string, action string")
    sessions = spark.createDataFrame([("kept",)], "change string")
    out = ingestion.run_summary(3, rows, merged, found, sessions).first()
    assert (out.bars_received, out.bars_excluded, out.bars_inserted, out.sessions_upserted, out.issues) == (3, 2, 1, 0, {"bar_revised": 1, "null_value": 2})


def test_learning_reads_features_and_not_lines(spark, monkeypatch):
    """The many jobs of boosting read the written features; before, each that read the rows read all lines again."""
    seen = []
    boost = trees.boost

    def few(rows, *args, **more):
        seen.extend(rows.inputFiles())
        return boost(rows, *args, **more, rules=trees.Boosting(rounds=1, least=5))

    monkeypatch.setattr(trees, "boost", few)
    sf_dir = "/root/testdata/sf0.001"
    out = tree_queries.ml_15_boosted(spark, sf_dir)
    assert seen and not any("lineitem" in f for f in seen)
    assert out.drop("probability").exceptAll(rounded(features.assemble(item_bars(spark, sf_dir)).select("symbol", "ts", "period", "target"))).count() == 0
    assert out.where("probability is not null").count() > 0
