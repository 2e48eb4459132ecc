"""Queries of sources that verify what they read: chunk files with a manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.semantics import rounded
from tidemark.plans import sql
from tidemark.sources import chunks
from tidemark.sources.bars import five_minute_sides
from tidemark.sources.shared import fresh_folder


def _written(spark, sf_dir):
    """A folder of weekly chunks of the five-minute bars of events, with a manifest."""
    folder = fresh_folder(spark, "chunks")
    chunks.write_chunks(five_minute_sides(spark, sf_dir), folder)
    return folder


def _shown(df):
    return rounded(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def src_10_chunks(spark, sf_dir):
    """All bars, written as chunks and read back verified: bid and ask of each time."""
    return _shown(chunks.both_sides(chunks.read_chunks(spark, _written(spark, sf_dir))))


def src_11_replay(spark, sf_dir):
    """The bars of one window, from the chunks that reach into it, with a floor under the spread."""
    return _shown(chunks.replay_window(spark, _written(spark, sf_dir), "2024-01-09T06:00:00", "2024-01-11T18:00:00", 0.25))


def src_12_manifest(spark, sf_dir):
    """Each chunk as the manifest names it, and whether what is found agrees."""
    report = chunks.chunk_report(spark, _written(spark, sf_dir))
    return report.select("symbol", "side", "file", "rows", F.substring("first", 1, 19).alias("first"), F.substring("last", 1, 19).alias("last"), "found_rows", (F.col("sha256") == F.col("found_sha256")).alias("same"), "problem")


PRICES = ("open", "high", "low", "close")


def _sides(floor: float) -> str:
    bid, ask = ({c: f"{c} * {f!r}" for c in PRICES} for f in (0.9999, 1.0001))
    return ", ".join([sql.settled(bid[c], f"bid_{c}") for c in PRICES] + [sql.settled(f"greatest({ask[c]}, {bid[c]} + {floor!r})", f"ask_{c}") for c in PRICES])


SRC_10_SQL = f"WITH {sql.M5} SELECT symbol, ts, {_sides(0.0)} FROM m5"
SRC_11_SQL = f"WITH {sql.M5} SELECT symbol, ts, {_sides(0.25)} FROM m5 WHERE ts >= TIMESTAMP '2024-01-09 06:00:00' AND ts < TIMESTAMP '2024-01-11 18:00:00'"
# Weeks count from 1970-01-01; a chunk also holds the next one's first bar.
SRC_12_SQL = f"""WITH {sql.M5}, w AS (SELECT symbol, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS week, ts FROM m5),
f AS (SELECT symbol, week - 1 AS week, min(ts) AS ts FROM w GROUP BY symbol, week),
c AS (SELECT symbol, week, count(*) AS rows, min(ts) AS first, max(ts) AS last FROM (SELECT * FROM w UNION ALL SELECT f.symbol, f.week, f.ts FROM f SEMI JOIN w USING (symbol, week)) GROUP BY symbol, week)
SELECT symbol, side, symbol || '/' || side || '_M5_' || lpad(CAST(week AS VARCHAR), 6, '0') || '.parquet' AS file, rows, strftime(first, '%Y-%m-%dT%H:%M:%S') AS first, strftime(last, '%Y-%m-%dT%H:%M:%S') AS last,
       rows AS found_rows, true AS same, CAST(NULL AS VARCHAR) AS problem FROM c, (VALUES ('BID'), ('ASK')) AS s(side)"""

QUERIES = {f.__name__: f for f in (src_10_chunks, src_11_replay, src_12_manifest)}
SQL = dict(zip(QUERIES, (SRC_10_SQL, SRC_11_SQL, SRC_12_SQL), strict=True))
