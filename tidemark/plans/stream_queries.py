"""Queries of streams: events replayed in a given order, their results read back from where the streams write them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.semantics import rounded
from tidemark.plans import sql
from tidemark.sources.bars import table
from tidemark.sources.shared import fresh_folder
from tidemark.streaming import bars, revisions

#: Days of an arrival; every LATE-th event comes one arrival later.
DAYS, LATE = 3, 37
WIDTH, QUIET, DELAY = 3600, 6 * 3600, "4 days"
TICK = "symbol string, ts timestamp, event_id long, price double"


def _arrivals(spark, sf_dir, folder):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))
    slice_ = F.floor(F.unix_seconds("ts") / (DAYS * 86_400)).cast("int")
    revisions.write_arrivals(e.withColumn("arrival", slice_ + (F.col("event_id") % LATE == 0).cast("int")), folder, "arrival")


def _replayed(spark, sf_dir, make):
    """What the stream make(session, ticks) yields of all events."""
    root = fresh_folder(spark, "replay")
    _arrivals(spark, sf_dir, f"{root}/in")
    own = revisions.stateful_session(spark)
    stream = make(revisions.replayed(own, f"{root}/in", TICK))
    revisions.run_to_end(stream, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def stm_05_revisions(spark, sf_dir):
    """Late ticks with the bars before and after them, final bars, and silences (STM-11)."""
    return rounded(_replayed(spark, sf_dir, lambda ticks: revisions.revisions(ticks, WIDTH, QUIET, DELAY)))


_TICKS = f"""tk AS (SELECT event_type AS symbol, ts, event_id, value AS price, time_bucket(INTERVAL {WIDTH} SECOND, ts, TIMESTAMP '1970-01-01') AS bar, CAST(floor(epoch(ts) / {DAYS * 86400}) AS BIGINT) + (event_id % {LATE} = 0)::INT AS arrival FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY arrival, ts, event_id) AS o, max(ts) OVER (PARTITION BY symbol ORDER BY arrival, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM tk),
wm AS (SELECT max(ts) - INTERVAL {DELAY} AS mark FROM tk)"""
_NOW = "arg_min(p.price, row(p.ts, p.event_id)) AS open, max(p.price) AS high, min(p.price) AS low, arg_max(p.price, row(p.ts, p.event_id)) AS close"
_WAS = f"arg_min(p.price, row(p.ts, p.event_id)) FILTER (p.o < r.o) AS was_open, max(p.price) FILTER (p.o < r.o) AS was_high, min(p.price) FILTER (p.o < r.o) AS was_low, arg_max(p.price, row(p.ts, p.event_id)) FILTER (p.o < r.o) AS was_close"
_SHOW = sql.all_settled("open high low close was_open was_high was_low was_close")
STM_05_SQL = f"""WITH {_TICKS},
rv AS (SELECT r.symbol, 'revised' AS kind, r.bar, r.event_id, count(*) AS ticks, count(*) FILTER (p.o < r.o) AS was_ticks, {_NOW}, {_WAS} FROM o r JOIN o p ON p.symbol = r.symbol AND p.bar = r.bar AND p.o <= r.o WHERE r.newest >= r.bar + INTERVAL {WIDTH} SECOND GROUP BY r.symbol, r.bar, r.event_id),
fb AS (SELECT symbol, bar, count(*) AS ticks, {_NOW}, lead(bar) OVER (PARTITION BY symbol ORDER BY bar) AS nxt FROM o p GROUP BY symbol, bar),
fn AS (SELECT * FROM fb, wm WHERE bar + INTERVAL {WIDTH + QUIET} SECOND <= mark),
al AS (SELECT * FROM rv UNION ALL SELECT symbol, 'final', bar, NULL, ticks, NULL, open, high, low, close, NULL, NULL, NULL, NULL FROM fn
  UNION ALL SELECT symbol, 'stale', bar, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM fn WHERE nxt IS NULL OR nxt > bar + INTERVAL {QUIET} SECOND)
SELECT symbol, kind, bar, event_id, ticks, was_ticks, {_SHOW} FROM al"""


def stm_01_stream_bars(spark, sf_dir):
    """Bars of the replayed quotes that the watermark has closed (STM-04: nothing after the cut-off)."""
    quotes = lambda t: t.select("symbol", "ts", (F.col("price") * 0.9999).alias("bid"), (F.col("price") * 1.0001).alias("ask"))
    out = _replayed(spark, sf_dir, lambda t: bars.stream_bars(quotes(t), f"{WIDTH} seconds", DELAY))
    return rounded(out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("closed_at").cast("timestamp_ntz").alias("closed_at"), "high", "low", "spread", "quotes"))


STM_01_SQL = f"""WITH {_TICKS} SELECT symbol, bar AS ts, bar + INTERVAL {WIDTH} SECOND AS closed_at, {sql.settled('max((price * 0.9999 + price * 1.0001) / 2)', 'high')}, {sql.settled('min((price * 0.9999 + price * 1.0001) / 2)', 'low')}, {sql.settled('avg(price * 1.0001 - price * 0.9999)', 'spread')}, count(*) AS quotes
FROM tk, wm WHERE bar + INTERVAL {WIDTH} SECOND <= mark GROUP BY symbol, bar"""


def stm_14_distinct_alerts(spark, sf_dir):
    """One alert a day for each kind of event and third of its events, whichever of them came first."""
    keyed = lambda t: t.withColumn("alert_id", F.concat_ws("|", "symbol", (F.col("event_id") % 3).cast("string"), F.to_date("ts").cast("string")))
    out = _replayed(spark, sf_dir, lambda t: bars.distinct_alerts(keyed(t), "8 days").select("alert_id", "symbol"))
    return out


STM_14_SQL = f"WITH {_TICKS} SELECT DISTINCT symbol || '|' || CAST(event_id % 3 AS VARCHAR) || '|' || strftime(ts, '%Y-%m-%d') AS alert_id, symbol FROM tk"

QUERIES = {f.__name__: f for f in (stm_05_revisions, stm_01_stream_bars, stm_14_distinct_alerts)}
SQL = dict(zip(QUERIES, (STM_05_SQL, STM_01_SQL, STM_14_SQL), strict=True))
