"""Late ticks, silences and restarts of the stateful stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import revisions

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
TICK = "symbol string, ts timestamp, event_id long, price double"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def arrive(spark, folder, *arrivals, first=0):
    rows = [(s, at(m), i, p, first + k) for k, ticks in enumerate(arrivals) for s, m, i, p in ticks]
    revisions.write_arrivals(spark.createDataFrame(rows, TICK + ", arrival int"), folder, "arrival")


def run(spark, root, **options):
    own = revisions.stateful_session(spark, 2)
    stream = revisions.revisions(revisions.replayed(own, f"{root}/in", TICK), **({"width": 300, "quiet": 600, "late": "30 minutes"} | options))
    revisions.run_to_end(stream, f"{root}/out", f"{root}/checkpoint")
    rows = spark.read.schema(stream.schema).parquet(f"{root}/out").collect()
    minute = lambda b: int((b.replace(tzinfo=dt.timezone.utc) - START).total_seconds() // 60)
    return sorted(((r.kind, r.symbol, minute(r.bar), r.event_id, r.ticks, r.was_ticks, (r.open, r.high, r.low, r.close), (r.was_open, r.was_high, r.was_low, r.was_close)) for r in rows), key=str)


NONE = (None,) * 4
FIRST = [("A", 1, 1, 10.0), ("A", 3, 2, 12.0), ("A", 6, 3, 11.0), ("B", 2, 1, 5.0)]
SECOND = [("A", 2, 9, 20.0), ("A", 7, 4, 9.0), ("A", 12, 5, 9.5)]  # the first is late: its bar has ended
LAST = [("A", 100, 6, 1.0)]


def test_a_late_tick_amends_a_closed_bar_and_silence_is_one_alert(spark, tmp_path):
    root = str(tmp_path)
    arrive(spark, f"{root}/in", FIRST, SECOND, LAST)
    found = run(spark, root)
    assert [x for x in found if x[0] == "revised"] == [("revised", "A", 0, 9, 3, 2, (10.0, 20.0, 10.0, 12.0), (10.0, 12.0, 10.0, 12.0))]
    assert [x[:5] + x[6:7] for x in found if x[0] == "final"] == [
        ("final", "A", 0, None, 3, (10.0, 20.0, 10.0, 12.0)), ("final", "A", 10, None, 1, (9.5,) * 4), ("final", "A", 5, None, 2, (11.0, 11.0, 9.0, 9.0)), ("final", "B", 0, None, 1, (5.0,) * 4),
    ]
    # A falls silent after its bar of minute 10, B after its only one; the last tick is still open
    assert [x[:3] for x in found if x[0] == "stale"] == [("stale", "A", 10), ("stale", "B", 0)]


def test_a_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    arrive(spark, f"{one}/in", FIRST, SECOND, LAST)
    whole = run(spark, one)
    arrive(spark, f"{two}/in", FIRST)
    assert not [x for x in run(spark, two) if x[0] == "revised"]
    arrive(spark, f"{two}/in", SECOND, LAST, first=1)
    assert run(spark, two) == whole  # state of the first run: the bar that the late tick amends
    assert run(spark, two) == whole  # nothing new, nothing again


def test_a_bar_known_only_from_a_late_tick(spark, tmp_path):
    root = str(tmp_path)
    arrive(spark, f"{root}/in", [("A", 20, 1, 1.0)], [("A", 3, 2, 7.0)], [("A", 90, 3, 2.0)])
    found = run(spark, root)
    assert [x for x in found if x[0] == "revised"] == [("revised", "A", 0, 2, 1, 0, (7.0,) * 4, NONE)]
    assert [x[:3] for x in found if x[0] == "stale"] == [("stale", "A", 0), ("stale", "A", 20)]


def test_ticks_behind_the_watermark_are_dropped(spark, tmp_path):
    root = str(tmp_path)
    arrive(spark, f"{root}/in", [("A", 1, 1, 1.0)], [("A", 200, 2, 2.0)], [("A", 2, 3, 50.0), ("A", 201, 4, 2.0)], [("A", 400, 5, 1.0)])
    finals = [x for x in run(spark, root) if x[0] == "final"]
    assert [(x[2], x[4], x[6]) for x in finals] == [(0, 1, (1.0,) * 4), (200, 2, (2.0,) * 4)]


def test_quiet_time_of_whole_bars(spark):
    with pytest.raises(ValueError):
        revisions.Revisions(300, 400)


def test_arrivals_are_read_in_their_order(spark, tmp_path):
    df = spark.range(6).select((5 - F.col("id")).cast("int").alias("arrival"), F.col("id").alias("v"))
    revisions.write_arrivals(df, f"{tmp_path}/in", "arrival")
    seen = []
    stream = revisions.replayed(spark, f"{tmp_path}/in", "v long")
    stream.writeStream.foreachBatch(lambda batch, _: seen.append([r.v for r in batch.collect()])).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
    assert seen == [[v] for v in (5, 4, 3, 2, 1, 0)]
