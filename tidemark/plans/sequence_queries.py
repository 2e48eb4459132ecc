"""Queries of ordered patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.semantics import rounded
from tidemark.operators import sequences
from tidemark.plans import sql
from tidemark.sources.bars import bucket_start, five_minute_quotes


#: Minutes of the bars whose readiness is shown beside the hours', which is rare.
FRAMES = (60, 15, 5)


def cdl_25_hourly_veto(spark, sf_dir):
    m5, found = five_minute_quotes(spark, sf_dir), None
    for minutes in FRAMES:
        bars = m5.groupBy("symbol", bucket_start(F.col("ts"), minutes * 60).alias("at")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close")).withColumnRenamed("at", "ts")
        ready = sequences.hourly_veto(bars, minutes).withColumn("minutes", F.lit(minutes))
        found = ready if found is None else found.unionByName(ready)
    return rounded(found)


def cdl_26_sweep_retests(spark, sf_dir):
    return rounded(sequences.sweep_retests(five_minute_quotes(spark, sf_dir)))


def cdl_27_session_setups(spark, sf_dir):
    return rounded(sequences.session_setups(five_minute_quotes(spark, sf_dir)))


def _buckets(source: str, needed: int) -> str:
    return f"""SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS ref, arg_min(open, ts) AS o, arg_max(close, ts) AS c, max(high) AS rh, min(low) AS rl FROM {source} GROUP BY ALL HAVING count(*) = {needed}"""


_SWEEP = "high > rh AND close > rl AND close < rh"


def _ready(minutes: int) -> tuple[str, str]:
    """CTEs of one frame's bars, and the rows that are ready."""
    h, r, s, m, a, q = (f"{c}_{minutes}" for c in "hrsmaq")
    bucket = lambda n: f"time_bucket(INTERVAL {n} MINUTE, ts, TIMESTAMP '1970-01-01')"
    ctes = f"""{h}_0 AS (SELECT symbol, {bucket(minutes)} AS at_ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM m5 GROUP BY symbol, at_ts),
{h}_1 AS (SELECT * EXCLUDE (at_ts), at_ts AS ts FROM {h}_0),
{h} AS MATERIALIZED (SELECT *, {bucket(4 * minutes)} AS own, row_number() OVER ({sql.W}) - 1 AS i, min(low) OVER ({sql.W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS structure, ts - lag(ts, 15) OVER ({sql.W}) = INTERVAL {15 * minutes} MINUTE AS whole FROM {h}_1),
{r} AS (SELECT symbol, own, arg_min(open, ts) AS o, arg_max(close, ts) AS c, max(high) AS rh, min(low) AS rl FROM {h} GROUP BY ALL HAVING count(*) = 4),
{s} AS (SELECT h.*, rh, rl FROM {h} h JOIN {r} r ON r.symbol = h.symbol AND r.own = h.own - INTERVAL {4 * minutes} MINUTE WHERE h.i >= 3 AND c < o AND {_SWEEP} AND low >= rl),
{m} AS (SELECT s.symbol, s.i, min(k.i) AS j FROM {s} s JOIN {h} k ON k.symbol = s.symbol AND k.i BETWEEN s.i + 1 AND s.i + 7 WHERE k.close < s.structure AND k.close < k.open
        AND (SELECT max(z.high) > min(z.low) FROM {h} z WHERE z.symbol = s.symbol AND z.i BETWEEN s.i AND k.i) GROUP BY ALL),
{a} AS (SELECT s.*, m.j, (SELECT max(high) FROM {h} z WHERE z.symbol = s.symbol AND z.i BETWEEN s.i AND m.j) AS origin, (SELECT min(low) FROM {h} z WHERE z.symbol = s.symbol AND z.i BETWEEN s.i AND m.j) AS base FROM {s} s JOIN {m} m ON m.symbol = s.symbol AND m.i = s.i),
{q} AS (SELECT a.symbol, t.ts, a.ts AS swept_at, (SELECT z.ts FROM {h} z WHERE z.symbol = a.symbol AND z.i = a.j) AS broke_at, rh AS reference_high, rl AS reference_low, a.structure, origin, base, base + 0.62 * (origin - base) AS zone_low, base + 0.79 * (origin - base) AS zone_high, t.high, t.open, t.close
      FROM {a} a JOIN {h} t ON t.symbol = a.symbol AND t.i BETWEEN a.j + 1 AND a.i + 8 WHERE t.whole
        AND NOT EXISTS (SELECT 1 FROM {h} z WHERE z.symbol = a.symbol AND z.i BETWEEN a.j + 1 AND t.i AND (z.high >= origin OR (z.i < t.i AND z.low < base))))"""
    rows = f"""(SELECT {minutes} AS minutes, symbol, ts, swept_at, broke_at, {sql.all_settled('reference_high reference_low structure origin base zone_low zone_high')} FROM {q}
WHERE high >= zone_low AND high <= zone_high AND close < zone_low AND close < open AND close < reference_high AND close > reference_low QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY swept_at DESC) = 1)"""
    return ctes, rows


_READY = [_ready(n) for n in FRAMES]
CDL_25_SQL = f"WITH {sql.M5}, {', '.join(c for c, _ in _READY)} " + " UNION ALL ".join(r for _, r in _READY)


def _courses(horizon: int, settle: int, floored: bool) -> str:
    """CTEs: d, the bars of the course of each candidate (CTE cand: symbol, i, ts, session, floor, structure, ...), one step after the other; e, how each ends; t, those taken."""
    bottom, top = ("(d.low0 + {0} * (d.origin - d.low0))".format(p) for p in (0.62, 0.79))
    lower = "least(d.low0, k.low)"
    bottom2, top2 = (f"({lower} + {p} * (d.origin - {lower}))" for p in (0.62, 0.79))
    settled = "true" if settle == 0 else f"(d.settled OR k.i - CASE WHEN k.low < d.low0 THEN k.i ELSE d.lowest END >= {settle})"
    hits = f"k.high >= {bottom2} AND {settled}"
    sound = f"k.high <= {top2} AND k.close < {bottom2} AND k.close < k.open AND k.close > d.floor"
    ends = f"""CASE WHEN k.session <> d.session THEN 'session' WHEN k.gap THEN 'gap' WHEN k.i - d.i > {horizon} THEN 'expired' WHEN k.high >= d.origin THEN 'origin' {"WHEN k.low <= d.floor THEN 'floor'" if floored else ""}
      WHEN d.broke IS NULL THEN NULL WHEN k.low < d.low0 AND d.settled THEN 'new_low' WHEN {hits} THEN CASE WHEN {sound} THEN 'retest' ELSE 'passed' END END"""
    breaks = "d.broke IS NULL AND k.close < d.structure AND k.close < k.open"
    stop = f"(k.session <> d.session OR k.gap OR k.i - d.i > {horizon} OR k.high >= d.origin {'OR k.low <= d.floor' if floored else ''} OR (d.broke IS NOT NULL AND k.low < d.low0 AND d.settled))"
    return f"""d AS (SELECT symbol, i, i AS j, session, floor, structure, high AS origin, low AS low0, CAST(NULL AS BIGINT) AS broke, CAST(NULL AS BIGINT) AS lowest, {str(settle == 0).lower()} AS settled, false AS displaced, false AS gap_seen, CAST(NULL AS VARCHAR) AS outcome FROM cand
  UNION ALL SELECT d.symbol, d.i, k.i, d.session, d.floor, d.structure, d.origin, CASE WHEN {stop} THEN d.low0 ELSE {lower} END, CASE WHEN {breaks} AND NOT {stop} THEN k.i ELSE d.broke END,
    CASE WHEN {breaks} OR k.low < d.low0 THEN k.i ELSE d.lowest END, CASE WHEN d.broke IS NULL THEN d.settled ELSE {settled} END, d.displaced OR coalesce({breaks} AND NOT {stop} AND k.open - k.close >= 1.25 * k.median_body, false),
    d.gap_seen OR coalesce((d.broke IS NOT NULL OR ({breaks})) AND NOT {stop} AND k.high < k.low_2, false), {ends}
  FROM d JOIN bar k ON k.symbol = d.symbol AND k.i = d.j + 1 WHERE d.outcome IS NULL),
e AS MATERIALIZED (SELECT * EXCLUDE (outcome, j), coalesce(outcome, 'open') AS outcome, CASE WHEN outcome IS NULL THEN j + 1 ELSE j END AS fin FROM d QUALIFY row_number() OVER (PARTITION BY symbol, i ORDER BY j DESC) = 1),
n AS MATERIALIZED (SELECT e.*, (SELECT min(o.i) FROM e o WHERE o.symbol = e.symbol AND o.i >= e.fin) AS nxt, row_number() OVER (PARTITION BY symbol ORDER BY i) AS place FROM e),
t AS (SELECT * FROM n WHERE place = 1 UNION ALL SELECT n.* FROM t JOIN n ON n.symbol = t.symbol AND n.i = t.nxt)"""


_SHOWN = f"""{sql.settled('origin', 'origin')}, {sql.settled('low0', 'base')}, {sql.settled('low0 + 0.62 * (origin - low0)', 'zone_low')}, {sql.settled('low0 + 0.79 * (origin - low0)', 'zone_high')}"""
_BAR = f"""bar AS MATERIALIZED (SELECT *, false AS gap, 0 AS session, CAST(NULL AS DOUBLE) AS median_body, lag(low, 2) OVER ({sql.W}) AS low_2 FROM m5)"""
CDL_26_SQL = f"""WITH RECURSIVE {sql.M5}, {_BAR}, r AS ({_buckets('m5', 48)}), m AS (SELECT *, min(low) OVER ({sql.W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS structure FROM bar),
cand AS (SELECT m.*, rl AS floor FROM m JOIN r ON r.symbol = m.symbol AND r.ref = time_bucket(INTERVAL 4 HOUR, m.ts, TIMESTAMP '1970-01-01') - INTERVAL 4 HOUR WHERE i >= 3 AND c < o AND {_SWEEP} AND low >= rl),
{_courses(12, 0, False)}
SELECT t.symbol, b.ts AS swept_at, k.ts AS broke_at, f.ts AS ended_at, outcome, {_SHOWN} FROM t JOIN m5 b ON b.symbol = t.symbol AND b.i = t.i LEFT JOIN m5 k ON k.symbol = t.symbol AND k.i = t.broke LEFT JOIN m5 f ON f.symbol = t.symbol AND f.i = t.fin"""

_NAMES = {s[0]: s[1:] for s in sequences.SESSIONS}
_IN = lambda a, z: "CASE " + " ".join(f"WHEN hour(ts) >= {s[a]} AND hour(ts) < {s[z]} THEN {k}" for k, s in enumerate(sequences.SESSIONS)) + " END"
_STRENGTH = "least(0.95, 0.5 + 0.4 * abs(f.close - f.open) / greatest(f.high - f.low, 1e-12))"
CDL_27_SQL = f"""WITH RECURSIVE {sql.M5},
g AS (SELECT *, {_IN(3, 4)} AS trades, {_IN(1, 2)} AS refers, CAST(ts AS DATE) AS day, min(low) OVER ({sql.W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS structure, lag(low, 2) OVER ({sql.W}) AS low_2, lag(close) OVER ({sql.W}) AS close_1, {sql.full('avg(close)', 'close', 20, 'prior')} AS mean20,
      CASE WHEN i >= 20 THEN median(abs(close - open)) OVER ({sql.W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS median_body, ts - lag(ts, 3) OVER ({sql.W}) = INTERVAL 15 MINUTE AS three FROM m5),
bar AS MATERIALIZED (SELECT *, false AS gap, coalesce(day - DATE '1970-01-01', 0) * 4 + coalesce(trades, -1000000) AS session FROM g),
r AS (SELECT symbol, CASE WHEN refers = 0 THEN day + 1 ELSE day END AS of_day, refers, max(high) AS rh, min(low) AS rl, count(*) AS n FROM g WHERE refers IS NOT NULL GROUP BY ALL),
cand AS (SELECT bar.*, rl AS floor FROM bar JOIN r ON r.symbol = bar.symbol AND r.of_day = bar.day AND r.refers = bar.trades AND r.n = CASE bar.trades WHEN 0 THEN 24 WHEN 1 THEN 96 ELSE 60 END WHERE i >= 20 AND {_SWEEP} AND low > rl AND three),
{_courses(36, 2, True)}
SELECT t.symbol, CASE b.trades WHEN 0 THEN 'tokyo' WHEN 1 THEN 'london' ELSE 'new_york' END AS session, b.ts AS swept_at, k.ts AS broke_at, f.ts AS ended_at, outcome, {_SHOWN},
       {sql.settled(f"CASE WHEN outcome = 'retest' THEN {_STRENGTH} END", 'reversal')}, {sql.settled(f"CASE WHEN outcome = 'retest' AND b.close_1 < b.mean20 THEN {_STRENGTH} END", 'continuation')},
       {sql.settled(f"CASE WHEN outcome = 'retest' AND displaced AND gap_seen THEN {_STRENGTH} END", 'momentum')}
FROM t JOIN bar b ON b.symbol = t.symbol AND b.i = t.i LEFT JOIN m5 k ON k.symbol = t.symbol AND k.i = t.broke LEFT JOIN m5 f ON f.symbol = t.symbol AND f.i = t.fin"""

QUERIES = {f.__name__: f for f in (cdl_25_hourly_veto, cdl_26_sweep_retests, cdl_27_session_setups)}
SQL = dict(zip(QUERIES, (CDL_25_SQL, CDL_26_SQL, CDL_27_SQL), strict=True))
