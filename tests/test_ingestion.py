"""Upserts, runs and findings; frozen files and rules that name what is wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingestion
from tidemark.sources import frozen

DAY = dt.datetime(2024, 1, 1)
BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, adj_close double"


def bar(symbol, day, price=10.0, volume=5.0, adj=10.0):
    high, low = (None, None) if price is None else (price + 1, price - 1)
    return (symbol, DAY + dt.timedelta(days=day), price, high, low, price, volume, adj)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), BAR)


def test_upsert_is_null_safe(spark):
    schema = "k string, a int, source string"
    old = spark.createDataFrame([("x", 1, "old"), ("y", None, "old"), ("z", 3, "old"), (None, 1, "old"), ("w", None, "old")], schema)
    new = spark.createDataFrame([("x", 1, "new"), ("y", 2, "new"), ("n", 5, "new"), (None, None, "new"), ("w", None, "new")], schema)
    got = {r.k: (r.a, r.source, r.change) for r in ingestion.upsert(old, new, ("k",), ("a",), ("source",)).collect()}
    assert got == {"x": (1, "old", "unchanged"), "y": (2, "new", "updated"), "z": (3, "old", "kept"), "n": (5, "new", "inserted"), None: (None, "new", "updated"), "w": (None, "old", "unchanged")}
    assert ingestion.upsert(old.limit(0), new.limit(0), ("k",), ("a",)).count() == 0


def test_merge_of_bars(spark):
    old = frame(spark, bar("A", 0), bar("A", 1), bar("A", 2), bar("A", 3, adj=None), bar("A", 4), bar("A", 5, adj=0.0))
    new = frame(spark, bar("A", 0, volume=6.0), bar("A", 1, adj=10.0 * (1 + 1e-7)), bar("A", 2, adj=11.0), bar("A", 3, adj=9.0), bar("A", 5, adj=0.0), bar("B", 0))
    got = {(r.symbol, (r.ts - DAY).days): r for r in ingestion.merge_bars(old, new).collect()}
    assert {k: r.change for k, r in got.items()} == {("A", 0): "updated", ("A", 1): "unchanged", ("A", 2): "updated", ("A", 3): "updated", ("A", 4): "kept", ("A", 5): "unchanged", ("B", 0): "inserted"}
    assert got["A", 0].raw == ["volume"] and got["A", 1].ignored and got["A", 1].adj_close == 10.0  # noise keeps the stored value
    assert got["A", 2].restated and got["A", 2].adjusted == pytest.approx(0.1) and got["A", 3].restated and got["A", 3].adjusted is None


def test_a_repeated_run_replaces_its_parts(spark, tmp_path):
    folder, as_of = f"{tmp_path}/i", F.lit(DAY + dt.timedelta(days=30)).cast("timestamp_ntz")
    sessions = spark.createDataFrame([(DAY, "inserted")], "session timestamp_ntz, change string")
    first = ingestion.ingest(spark, folder, 1, None, frame(spark, bar("A", 0), bar("A", 0), bar("A", 1), bar("A", 40), bar("B", 0, price=-1.0)), sessions, as_of)
    assert first.count() == 2
    for _ in range(2):
        second = ingestion.ingest(spark, folder, 2, first, frame(spark, bar("A", 1, volume=9.0), bar("A", 2, adj=None), bar("A", 3, price=None)), sessions, as_of)
    assert second.count() == 3
    runs = {r.run_id: r for r in spark.read.parquet(f"{folder}/runs").collect()}
    counts = lambda r: (r.bars_received, r.bars_inserted, r.bars_updated, r.bars_unchanged, r.bars_excluded, r.sessions_upserted, r.issues)
    assert counts(runs[1]) == (5, 2, 0, 0, 3, 1, {"duplicate_bar": 1, "future_bar": 1, "non_positive_price": 1})
    assert counts(runs[2]) == (3, 1, 1, 0, 1, 1, {"bar_revised": 1, "null_value": 1})
    events = spark.read.parquet(f"{folder}/events")
    assert events.count() == 5 and ingestion.since(events, F.lit(DAY + dt.timedelta(days=1)).cast("timestamp_ntz"), 1).count() == 2
    assert ingestion.latest_run(spark.read.parquet(f"{folder}/runs")).first().run_id == 2
    alerts = ingestion.run_alerts(spark.createDataFrame([(1, "failed"), (2, "succeeded")], "run_id int, status string"), events.withColumn("check", F.when(F.col("check") == "future_bar", "provider_failure").otherwise(F.col("check"))))
    assert sorted((r.kind, r.severity) for r in alerts.collect()) == sorted([("DATA_INGESTION_FAILED", "critical"), ("DATA_PROVIDER_FAILURE", "critical"), *[("DATA_QUALITY_EVENT", "critical")] * 3, ("DATA_QUALITY_EVENT", "warning")])
    assert alerts.select("alert_id").distinct().count() == 6


def test_transitions_that_are_alerts(spark):
    rows = [("s", DAY, "x", c, p) for p, c in (("FLAT", "LONG"), ("LONG", "INSUFFICIENT_DATA"), ("INSUFFICIENT_DATA", "FLAT"), ("LONG", "LONG"), (None, "LONG"))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, strategy string, state string, state_in_effect string")
    assert sorted((r.previous, r.current) for r in ingestion.transition_alerts(df).collect()) == [("FLAT", "LONG"), ("INSUFFICIENT_DATA", "FLAT")]


HEAD = "note,date,close,open,high,low,adj_close,volume,dividends,splits\n"


def price_file(tmp_path, *lines, head=HEAD):
    path = tmp_path / "prices.csv"
    path.write_text(head + "".join(x + "\n" for x in lines))
    return str(path)


GOOD = ("a,2024-01-02,1,2,3,0.5,1,100,0,0", "b,2024-01-03,1.5,2,3,0.5,1,,0,0", "c,2024-01-04,2,2,3,0.5,1,1e2,0,0")


def test_columns_by_name_and_cut(spark, tmp_path):
    rows = frozen.price_csv(spark, price_file(tmp_path, *GOOD), "2024-01-03").orderBy("date").collect()
    assert [(str(r.date), r.open, r.close, r.volume) for r in rows] == [("2024-01-02", 2.0, 1.0, 100.0), ("2024-01-03", 2.0, 1.5, None)]


@pytest.mark.parametrize(
    "line, problem",
    [("x,2024-01-05,1,2,3", "line"), ("x,2024-01-05,1,2,3,0.5,1,100,0,0,9", "line"), ("x,2024-13-05,1,2,3,0.5,1,100,0,0", "date"), ("x,,1,2,3,0.5,1,100,0,0", "date"), ("x,2024-01-05,1,zwei,3,0.5,1,100,0,0", "open"), ("x,2024-1-5,1,2,3,0.5,1,100,0,0", "date")],
)
def test_each_malformed_line_is_named(spark, tmp_path, line, problem):
    path = price_file(tmp_path, *GOOD, line)
    found = frozen.violations(frozen.typed(frozen.raw_lines(spark, path, "date", frozen.PRICES), "date", frozen.PRICES)).collect()
    assert found[0].problem == problem and {f.problem for f in found} <= {problem, "date"}
    if problem == "line":
        assert found[0].line == line
    with pytest.raises(frozen.FrozenFileError, match=problem):
        frozen.price_csv(spark, path)


def test_missing_columns_and_repeated_days(spark, tmp_path):
    with pytest.raises(frozen.FrozenFileError, match="splits"):
        frozen.price_csv(spark, price_file(tmp_path, head=HEAD.replace(",splits", "")))
    with pytest.raises(frozen.FrozenFileError, match="2024-01-02 occurs 2 times"):
        frozen.price_csv(spark, price_file(tmp_path, *GOOD, GOOD[0]))
    assert frozen.price_csv(spark, price_file(tmp_path)).count() == 0


def test_chronology(spark):
    rows = [("a", 1, "train"), ("a", 2, "test"), ("b", 2, "train"), ("b", 2, "test"), ("c", 1, "train"), ("d", 3, "test")]
    out = {r.k: r.ordered for r in frozen.chronology(spark.createDataFrame(rows, "k string, ts int, part string"), "part", "train", "ts", "k").collect()}
    assert out == {"a": True, "b": False, "c": True, "d": True}


ASSET = "id string, symbol string, kind string, tracks string, product_tracks string, cost_class string"
ASSETS = [(f"a{i}", f"S{i}", "proxy", "x", "x", "one") for i in range(4)]
LEGS = [("e", None, "E", 0.6), ("b", "a1", "-", 0.4)]


@pytest.mark.parametrize(
    "assets, legs, want",
    [
        (ASSETS, LEGS, set()), (ASSETS[:3], LEGS, {("asset_count", "3")}), ([*ASSETS, ASSETS[0]], LEGS, {("duplicate_id", "a0"), ("duplicate_symbol", "S0")}),
        ([*ASSETS, ("z", "Z", "proxy", "x", "y", "two")], LEGS, {("unknown_cost_class", "z two"), ("series_differs", "z")}), ([*ASSETS, ("z", "Z", "index", "x", None, None)], LEGS, {("unknown_cost_class", "z")}),
        (ASSETS, [("a2", None, "E", 0.6), ("b", "q", "-", 0.5)], {("leg_weights", "1.1"), ("unknown_asset", "q"), ("leg_id_clashes", "a2")}), (ASSETS, [("e", None, "S1", 1.0)], {("duplicate_symbol", "S1")}),
    ],
)
def test_universe_rules(spark, assets, legs, want):
    found = frozen.universe_violations(spark.createDataFrame(assets, ASSET), spark.createDataFrame(legs, "id string, same_as string, symbol string, weight double"), spark.createDataFrame([("one",)], "cost_class string"))
    assert {(r.rule, r.subject) for r in found.collect()} == want
