"""Queries of labels, their weights and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.semantics import rounded, smoothed
from tidemark.operators import labels
from tidemark.operators.indicators import true_range
from tidemark.plans import sql
from tidemark.sources.bars import five_minute_quotes

RULES = labels.Barriers(risk_percent=0.5, unit_step=1.0)


def _bars(spark, sf_dir):
    """Five-minute bars with ATR and both sides."""
    mid = five_minute_quotes(spark, sf_dir).withColumn("__range", true_range())
    b = smoothed(mid, {"atr": ("__range", 14, 1 / 14)}).drop("__range").withColumn("atr", F.round("atr", 10))
    return b.withColumns({f"{side}_{c}": F.col(c) * f for side, f in (("bid", 0.9999), ("ask", 1.0001)) for c in ("open", "high", "low", "close")})


def sim_32_labels(spark, sf_dir):
    """What a sale at the next open of each five-minute bar brings."""
    return rounded(labels.barrier_labels(_bars(spark, sf_dir), -1, RULES))


_ATR = f"""m5c AS (SELECT *, lag(close) OVER ({sql.W}) AS c1 FROM m5), m5t AS (SELECT *, CASE WHEN c1 IS NOT NULL THEN greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr FROM m5c)"""
_BARS = f"""{sql.M5}, {_ATR}, {sql.smooth('s_atr', 'm5t', 'tr', 14, 1 / 14)},
b AS MATERIALIZED (SELECT m5t.*, round(s_atr.y, 10) AS atr, CAST(timezone('America/New_York', timezone('UTC', m5t.ts)) + INTERVAL 7 HOUR AS DATE) AS day FROM m5t LEFT JOIN s_atr ON s_atr.symbol = m5t.symbol AND s_atr.ts = m5t.ts)"""
_FLOOR = 2 * RULES.least_commission / RULES.max_fee_risk / RULES.max_units
SIM_32_SQL = f"""WITH RECURSIVE {_BARS},
r AS (SELECT b.*, greatest(2.0 * atr, {_FLOOR!r}) AS risk, lead(ts, 96) OVER ({sql.W}) AS far, lead(open) OVER ({sql.W}) * 0.9999 AS entry, lead(day) OVER ({sql.W}) AS day0 FROM b),
u AS (SELECT *, floor(least(50.0 / risk, 5000.0)) AS units, far - ts = INTERVAL 480 MINUTE AS whole FROM r),
f AS (SELECT *, greatest(2.0, 0.2e-4 * units * entry) AS fee FROM u),
v AS MATERIALIZED (SELECT *, coalesce(whole AND units >= 1 AND 2 * fee / (units * risk) <= 0.45 + 1e-9, false) AS valid FROM f),
p AS (SELECT v.symbol, v.ts, k.i - v.i AS age, k.day, k.open * 1.0001 AS o, k.high * 1.0001 AS hi, k.low * 1.0001 AS lo, k.close * 1.0001 AS cl, entry + risk AS stop, entry - 2.0 * risk AS goal
      FROM v JOIN b k ON k.symbol = v.symbol AND k.i BETWEEN v.i + 1 AND v.i + 96 WHERE v.valid),
x AS (SELECT symbol, ts, arg_min(row(age, day, CASE WHEN o >= stop THEN 'stop_gap' WHEN o <= goal THEN 'target_gap' WHEN hi >= stop THEN 'stop' WHEN lo <= goal THEN 'target' ELSE 'time' END,
        CASE WHEN o >= stop OR o <= goal THEN o WHEN hi >= stop THEN stop WHEN lo <= goal THEN goal ELSE cl END), age) AS e FROM p WHERE hi >= stop OR lo <= goal OR age = 96 GROUP BY symbol, ts),
z AS (SELECT symbol, ts, e[1] AS age, e[2] AS day, e[3] AS reason, e[4] AS price FROM x)
SELECT v.symbol, v.ts, far + INTERVAL 5 MINUTE AS label_end, reason, CAST(age AS INTEGER) AS bars,
       {sql.settled('(entry - price) / risk - (fee + greatest(2.0, 0.2e-4 * units * price) + greatest(0, z.day - day0) * 0.5e-4 * units * entry) / (units * risk)', 'net_r')}
FROM v LEFT JOIN z ON z.symbol = v.symbol AND z.ts = v.ts"""


def ml_12_forward_rows(spark, sf_dir):
    return rounded(labels.forward_rows(_bars(spark, sf_dir)))


_FORWARD = f"""{_BARS}, fw AS (SELECT symbol, ts, i, lead(ts, 96) OVER ({sql.W}) + INTERVAL 5 MINUTE AS label_end, lead(ts, 96) OVER ({sql.W}) - ts = INTERVAL 480 MINUTE AS whole,
  (lead(close, 96) OVER ({sql.W}) - lead(open) OVER ({sql.W})) / CASE WHEN atr > 0 THEN atr END AS move FROM b),
t AS MATERIALIZED (SELECT symbol, ts, i, label_end, CASE WHEN whole AND move IS NOT NULL THEN greatest(-20.0, least(20.0, move)) END AS target FROM fw)"""
ML_12_SQL = f"WITH RECURSIVE {_FORWARD} SELECT symbol, ts, label_end, {sql.settled('target', 'target')} FROM t"

#: Weeks that are tested one after the other, as (window, begin, end).
WEEKS = [(1, "2024-01-08", "2024-01-15"), (2, "2024-01-15", "2024-01-22"), (3, "2024-01-22", "2024-01-29")]


def ml_19_purged(spark, sf_dir):
    """Of each symbol's rows: how many are known, train before each week with an embargo, and train around each week."""
    rows = labels.forward_rows(_bars(spark, sf_dir)).where("target is not null")
    windows = spark.createDataFrame(WEEKS, "window int, begin string, end string").select("window", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("begin", "end")])
    around = labels.clear_of(rows, windows).groupBy("symbol", "window").agg(F.count("*").alias("around"), F.max("ts").alias("last_around"))
    first = F.lit("2024-01-02").cast("timestamp_ntz")
    earlier = rows.groupBy("symbol").agg(F.count("*").alias("known"), *[F.count_if(labels.purged(rows, first, F.lit(a).cast("timestamp_ntz"))).alias(f"n{w}") for w, a, _ in WEEKS])
    before = F.element_at(F.array(*[F.col(f"n{w}") for w, _, _ in WEEKS]), F.col("window"))
    return around.join(earlier, "symbol").select("symbol", "window", "known", before.alias("before"), "around", "last_around")


ML_19_SQL = f"""WITH RECURSIVE {_FORWARD}, k AS (SELECT * FROM t WHERE target IS NOT NULL), w(win, a, z) AS (VALUES {", ".join(f"({w}, TIMESTAMP '{a}', TIMESTAMP '{z}')" for w, a, z in WEEKS)})
SELECT symbol, win AS window, count(*) AS known, count(*) FILTER (ts >= TIMESTAMP '2024-01-02' AND label_end < a - INTERVAL 24 HOUR) AS before,
       count(*) FILTER (ts >= z + INTERVAL 24 HOUR OR label_end <= a - INTERVAL 24 HOUR) AS around, max(ts) FILTER (ts >= z + INTERVAL 24 HOUR OR label_end <= a - INTERVAL 24 HOUR) AS last_around FROM k, w GROUP BY symbol, win"""


def _chosen(spark, sf_dir):
    """Labels at bars that fall by more than an ATR, weighted by the fall."""
    b = _bars(spark, sf_dir)
    fall = F.try_divide(F.col("open") - F.col("close"), F.col("atr"))
    rows = labels.forward_rows(b).join(b.select("symbol", "ts", fall.alias("weight")), ["symbol", "ts"])
    return b, rows.where("target is not null and weight > 1").select("symbol", "ts", "label_end", "weight")


def ml_22_uniqueness(spark, sf_dir):
    bars, chosen = _chosen(spark, sf_dir)
    return rounded(labels.uniqueness(bars.select("symbol", "ts"), chosen))


ML_22_SQL = f"""WITH RECURSIVE {_FORWARD}, c AS MATERIALIZED (SELECT t.symbol, t.ts, t.i, t.label_end, (b.open - b.close) / nullif(b.atr, 0) AS weight FROM t JOIN b ON b.symbol = t.symbol AND b.ts = t.ts WHERE target IS NOT NULL AND (b.open - b.close) / nullif(b.atr, 0) > 1),
n AS MATERIALIZED (SELECT m5.symbol, m5.i, count(*) AS covering FROM m5 JOIN c ON c.symbol = m5.symbol AND m5.i BETWEEN c.i AND c.i + 96 GROUP BY ALL),
q AS (SELECT c.symbol, c.ts, any_value(c.label_end) AS label_end, any_value(weight) AS weight, avg(1.0::DOUBLE / covering) AS uniqueness FROM c JOIN n ON n.symbol = c.symbol AND n.i BETWEEN c.i AND c.i + 96 GROUP BY c.symbol, c.ts)
SELECT symbol, ts, label_end, {sql.settled('uniqueness', 'uniqueness')}, {sql.settled('weight * uniqueness / avg(uniqueness) OVER ()', 'weight')} FROM q"""

def ml_23_economic(spark, sf_dir):
    return rounded(labels.economic(_bars(spark, sf_dir), RULES))


ML_23_SQL = f"""WITH RECURSIVE {_BARS}, e AS (SELECT symbol, ts, atr, close * 1.0001 AS ask, close * 0.9999 AS bid, CASE WHEN atr IS NOT NULL THEN greatest(2.0 * atr, {_FLOOR!r}) END AS stop FROM b), u AS (SELECT *, CASE WHEN stop IS NOT NULL THEN floor(least(50.0 / stop, 5000.0)) END AS units FROM e)
SELECT symbol, ts, {sql.settled('CASE WHEN atr IS NOT NULL THEN 2 * greatest(2.0, 0.2e-4 * units * ask) / greatest(units * stop, 1e-12) END', 'fee_r')}, {sql.settled('(ask - bid) / stop', 'spread_r')}, {sql.settled(f'2.0 * atr / {_FLOOR!r}', 'floor_ratio')}, {sql.settled('units / 5000.0', 'units_share')} FROM u"""

QUERIES = {f.__name__: f for f in (ml_23_economic, sim_32_labels, ml_12_forward_rows, ml_19_purged, ml_22_uniqueness)}
SQL = dict(zip(QUERIES, (ML_23_SQL, SIM_32_SQL, ML_12_SQL, ML_19_SQL, ML_22_SQL), strict=True))
