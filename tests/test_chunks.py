"""The chunk source reads what the sink wrote, opens only what is asked for and refuses what differs from the manifest."""

import datetime as dt
import io
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from tidemark.sources import chunks

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def rows(days=3, symbols=("A", "B"), skip=()):
    out = []
    for s in symbols:
        for side, f in (("BID", 1.0), ("ASK", 1.01)):
            for i in range(days * 288):
                if i // 288 not in skip:
                    p = (100 + i % 7) * f
                    out.append((s, side, START + dt.timedelta(minutes=5 * i), p, p + 1, p - 1, p + 0.5))
    return out


@pytest.fixture
def folder(spark, tmp_path):
    path = f"{tmp_path}/bars"
    chunks.write_chunks(spark.createDataFrame(rows(), chunks.SCHEMA).repartition(3), path, days=1)
    return path


def manifest(folder):
    return json.load(open(f"{folder}/manifest.json"))


def save(folder, said):
    json.dump(said, open(f"{folder}/manifest.json", "w"))


def test_round_trip_with_shared_bars_once(spark, folder):
    said = manifest(folder)["chunks"]
    assert len(said) == 12 and sorted({c["rows"] for c in said}) == [288, 289]  # all but the last hold the next one's first bar
    got = chunks.read_chunks(spark, folder).collect()
    key = lambda r: (r[0], r[1], r[2])
    assert sorted(((r.symbol, r.side, r.ts.astimezone(dt.timezone.utc), *r[3:]) for r in got), key=key) == sorted(rows(), key=key)
    assert chunks.both_sides(chunks.read_chunks(spark, folder), 5.0).where("round(ask_close - bid_close, 9) < 5").count() == 0


def test_only_chunks_of_the_window_are_opened(spark, folder):
    """All files but those of one day and symbol are damaged: reading that day works, reading another names the damaged chunk."""
    good = {c["file"] for c in manifest(folder)["chunks"] if c["symbol"] == "A" and c["first"].startswith("2024-01-02")}
    assert len(good) == 2
    for c in manifest(folder)["chunks"]:
        if c["file"] not in good:
            open(f"{folder}/{c['file']}", "ab").write(b"x")
    asked = dict(start="2024-01-02T06:00:00", end="2024-01-02T12:00:00", symbols=("A",))
    got = chunks.read_chunks(spark, folder, **asked)
    assert got.count() == 2 * 72 and got.rdd.getNumPartitions() >= 1
    with pytest.raises(PySparkException, match="SHA-256 of B/"):
        chunks.read_chunks(spark, folder, asked["start"], asked["end"]).count()


def test_filters_prune_partitions(folder):
    reader = chunks.PushedReader({"path": folder})
    assert len(reader.partitions()) == 12
    filters = [In(("symbol",), ("A", "C")), EqualTo(("side",), "BID"), GreaterThanOrEqual(("ts",), START + dt.timedelta(days=1, hours=1)), LessThan(("ts",), START + dt.timedelta(days=2))]
    assert list(reader.pushFilters(filters)) == filters
    assert [(c.symbol, c.side, c.first[:10]) for c in reader.partitions()] == [("A", "BID", "2024-01-02")]
    none = chunks.ChunkReader({"path": folder, "start": "2030-01-01"})
    assert [c.file for c in none.partitions()] == [""] and [*none.read(none.partitions()[0])] == []


def test_pushed_filters_reach_the_source(spark, folder):
    spark.dataSource.register(chunks.ChunkSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("bar_chunks").options(path=folder, pushdown="true").load().where((F.col("ts") < F.lit("2024-01-01 12:00:00").cast("timestamp")) & (F.col("symbol") == "B"))
        assert df.count() == 2 * 144 and df.rdd.getNumPartitions() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def replaced(folder, change):
    """Change the rows of the first chunk and let the manifest agree with the bytes."""
    import hashlib

    said = manifest(folder)
    c = said["chunks"][0]
    sink = io.BytesIO()
    table = change(pq.read_table(f"{folder}/{c['file']}"))
    pq.write_table(table, sink)
    open(f"{folder}/{c['file']}", "wb").write(sink.getvalue())
    c["sha256"], c["rows"] = hashlib.sha256(sink.getvalue()).hexdigest(), len(table)
    save(folder, said)


def set_column(name, value):
    return lambda t: t.set_column(t.schema.get_field_index(name), name, pa.array([value, *t.column(name).to_pylist()[1:]], t.schema.field(name).type))


@pytest.mark.parametrize(
    "harm, words",
    [
        (lambda f: os.remove(f"{f}/{manifest(f)['chunks'][0]['file']}"), "missing"),
        (lambda f: open(f"{f}/A/BID_M5_000000.parquet", "wb").write(b"x"), "does not list"),
        (lambda f: open(f"{f}/{manifest(f)['chunks'][0]['file']}", "ab").write(b"x"), "SHA-256"),
        (lambda f: os.remove(f"{f}/manifest.json"), "not finished"),
        (lambda f: save(f, manifest(f) | {"complete": False}), "not complete"),
        (lambda f: save(f, manifest(f) | {"upsampled": True}), "genuine"),
        (lambda f: save(f, manifest(f) | {"bar_size": "1 hour"}), "genuine"),
        (lambda f: save(f, {**manifest(f), "chunks": [c | {"rows": 5} for c in manifest(f)["chunks"]]}), "rows and not 5"),
        (lambda f: replaced(f, set_column("high", 1.0)), "impossible"),
        (lambda f: replaced(f, set_column("low", float("nan"))), "impossible"),
        (lambda f: replaced(f, set_column("close", None)), "impossible"),
        (lambda f: replaced(f, set_column("ts", START + dt.timedelta(seconds=7))), "off the five-minute grid"),
    ],
)
def test_what_differs_is_refused(spark, folder, harm, words):
    harm(folder)
    with pytest.raises((chunks.ChunkError, PySparkException), match=words):
        chunks.read_chunks(spark, folder).count()


def test_one_side_only_and_differing_overlaps(spark, folder, tmp_path):
    said = manifest(folder)
    for c in [c for c in said["chunks"] if (c["symbol"], c["side"]) == ("B", "ASK")]:
        os.remove(f"{folder}/{c['file']}")
        said["chunks"].remove(c)
    save(folder, said)
    with pytest.raises((chunks.ChunkError, PySparkException), match="no ASK chunks for B"):
        chunks.read_chunks(spark, folder).count()
    other = f"{tmp_path}/other"
    chunks.write_chunks(spark.createDataFrame(rows(), chunks.SCHEMA), other, days=1)
    replaced(other, lambda t: t.set_column(t.schema.get_field_index("close"), "close", pa.array([*t.column("close").to_pylist()[:-1], t.column("open")[-1].as_py()])))
    with pytest.raises(PySparkException, match="chunks differ"):
        chunks.read_chunks(spark, other).collect()


def test_report_names_each_problem(spark, folder):
    files = [c["file"] for c in manifest(folder)["chunks"]]
    os.remove(f"{folder}/{files[0]}")
    open(f"{folder}/{files[1]}", "ab").write(b"x")
    open(f"{folder}/A/ASK_M5_000009.parquet", "wb").write(b"no parquet")
    said = manifest(folder)
    said["chunks"][2]["rows"] += 1
    save(folder, said)
    found = {r.file: r.problem for r in chunks.chunk_report(spark, folder).collect()}
    assert {f: p for f, p in found.items() if p} == {files[0]: "missing", files[1]: "hash", files[2]: "rows", "A/ASK_M5_000009.parquet": "unlisted"} and len(found) == 13


def test_window_without_chunks_and_quiet_stretches(spark, tmp_path):
    path = f"{tmp_path}/gap"
    chunks.write_chunks(spark.createDataFrame(rows(3, ("A",), skip={1}), chunks.SCHEMA), path, days=1)
    assert len(manifest(path)["chunks"]) == 4
    assert chunks.replay_window(spark, path, "2024-01-03T00:00:00", "2024-01-03T00:10:00").count() == 2
    with pytest.raises(chunks.ChunkError, match="no chunks"):
        chunks.replay_window(spark, path, "2025-01-01T00:00:00", "2025-01-02T00:00:00")
