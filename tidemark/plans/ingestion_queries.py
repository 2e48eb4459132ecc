"""Queries of deliveries, their findings and alerts, and of frozen files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.semantics import rounded
from tidemark.operators import features, ingestion, strategies
from tidemark.operators.indicators import windowed
from tidemark.plans import sql
from tidemark.plans.quality_queries import AS_OF, ROWS, provider_rows
from tidemark.sources import frozen
from tidemark.sources.bars import item_bars, table
from tidemark.sources.shared import fresh_folder

#: Where the first delivery ends and the second one begins; the second restates adjustments of two months and raises small volumes.
FIRST_END, SECOND_START = "1995-07-01", "1994-07-01"


def _deliveries(spark, sf_dir):
    rows = provider_rows(spark, sf_dir)
    shift = F.when(F.month("ts") == 9, 1.01).when(F.month("ts") == 10, 1 + 1e-7).otherwise(1.0)
    later = rows.where(F.col("ts") >= F.lit(SECOND_START).cast("timestamp_ntz")).withColumns({"volume": F.when((F.col("volume") == 8) & (F.col("ts") < F.lit(FIRST_END).cast("timestamp_ntz")), 8.5).otherwise(F.col("volume")), "adj_close": F.col("adj_close") * shift})
    return rows.where(F.col("ts") < F.lit(FIRST_END).cast("timestamp_ntz")), later


def _calendar(rows, first_source):
    """Sessions of a delivery: the day, when it opens (an hour later in its second half) and who said so."""
    return rows.select(F.col("ts").alias("session")).distinct().select("session", (F.hour("session") + F.when(F.dayofmonth("session") > 15, first_source).otherwise(9)).alias("opens"), F.lit(f"source {first_source}").alias("source"))


def _ingested(spark, sf_dir):
    """Two deliveries, one after the other; the folder of what they left."""
    folder, as_of = fresh_folder(spark, "ingestion"), F.lit(AS_OF).cast("timestamp_ntz")
    stored, known = None, None
    for run_id, rows in enumerate(_deliveries(spark, sf_dir), 1):
        sessions = _calendar(rows, 8 + run_id)
        known = ingestion.upsert(sessions.limit(0) if known is None else known.drop("change"), sessions, ("session",), ("opens",), ("source",))
        stored = ingestion.ingest(spark, folder, run_id, stored, rows, known, as_of)
        known = spark.read.parquet(f"{folder}/sessions/run_id={run_id}")
    return folder


def src_22_ingestion(spark, sf_dir):
    runs = spark.read.parquet(f"{_ingested(spark, sf_dir)}/runs")
    return runs.select("run_id", "status", "bars_received", "bars_inserted", "bars_updated", "bars_unchanged", "bars_excluded", "noise_ignored", "sessions_upserted", F.to_json("issues").alias("issues"))


def src_24_latest_run(spark, sf_dir):
    run = ingestion.latest_run(spark.read.parquet(f"{_ingested(spark, sf_dir)}/runs"))
    return run.select("run_id", "bars_received", "bars_excluded")


def src_25_events_since(spark, sf_dir):
    """Findings of the second run from 1995 on."""
    events = spark.read.parquet(f"{_ingested(spark, sf_dir)}/events")
    found = ingestion.since(events, F.lit("1995-01-01").cast("timestamp_ntz"), 1)
    return rounded(found.select("run_id", "check", "severity", "action", "symbol", "ts", "bars", "value"))


def agg_44_issues(spark, sf_dir):
    return spark.read.parquet(f"{_ingested(spark, sf_dir)}/events").groupBy("run_id", "check").agg(F.count("*").alias("n"), F.sum("bars").alias("bars"))


def stm_12_quality_alerts(spark, sf_dir):
    """Alerts of the findings and runs, by kind and severity."""
    folder = _ingested(spark, sf_dir)
    alerts = ingestion.run_alerts(spark.read.parquet(f"{folder}/runs").select("run_id", F.when(F.col("run_id") == 1, "failed").otherwise(F.col("status")).alias("status")), spark.read.parquet(f"{folder}/events"))
    return alerts.groupBy("kind", "severity").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("subjects"))


_CASES = "CASE month(ts) WHEN 9 THEN 1.01::DOUBLE WHEN 10 THEN 1 + 1e-7 ELSE 1.0 END"
_CHECKED = lambda name, source: f"""{name}_2 AS (SELECT *, count(*) OVER k AS n, row_number() OVER (PARTITION BY symbol, ts, open, high, low, close, volume, adj_close) AS same_place, count(*) OVER (PARTITION BY symbol, ts, open, high, low, close, volume, adj_close) AS same FROM {source} WINDOW k AS (PARTITION BY symbol, ts)),
{name} AS (SELECT symbol, ts, open, high, low, close, volume, adj_close, CASE WHEN same <> n THEN 'conflicting_duplicate_bar' WHEN same_place > 1 THEN 'duplicate_bar' WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL THEN 'null_value'
  WHEN least(open, high, low, close) <= 0 THEN 'non_positive_price' WHEN adj_close <= 0 THEN 'non_positive_adj_close' WHEN high + 1e-6 < greatest(open, close, low) OR low - 1e-6 > least(open, close, high) THEN 'ohlc_inconsistent'
  WHEN volume < 0 THEN 'negative_volume' WHEN ts > TIMESTAMP '{AS_OF}' THEN 'future_bar' END AS rule FROM {name}_2)"""  # noqa: E731
RUNS = f"""{ROWS}, d1 AS (SELECT * FROM rows1 WHERE ts < TIMESTAMP '{FIRST_END}'),
d2 AS (SELECT symbol, ts, open, high, low, close, CASE WHEN volume = 8 AND ts < TIMESTAMP '{FIRST_END}' THEN 8.5 ELSE volume END AS volume, adj_close * {_CASES} AS adj_close FROM rows1 WHERE ts >= TIMESTAMP '{SECOND_START}'),
{_CHECKED('c1', 'd1')}, {_CHECKED('c2', 'd2')},
mg AS (SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.ts, b.ts) AS ts, a.symbol IS NULL AS ins, b.symbol IS NULL AS kept, a.adj_close IS DISTINCT FROM b.adj_close AS other,
    CAST(a.open IS DISTINCT FROM b.open AS INT) + CAST(a.high IS DISTINCT FROM b.high AS INT) + CAST(a.low IS DISTINCT FROM b.low AS INT) + CAST(a.close IS DISTINCT FROM b.close AS INT) + CAST(a.volume IS DISTINCT FROM b.volume AS INT) AS raws,
    abs(b.adj_close / a.adj_close - 1) AS moved, CASE WHEN a.adj_close IS NULL OR b.adj_close IS NULL THEN a.adj_close IS DISTINCT FROM b.adj_close ELSE abs(b.adj_close / a.adj_close - 1) > 1e-5 END AS adj
    FROM (SELECT * FROM c1 WHERE rule IS NULL) a FULL JOIN (SELECT * FROM c2 WHERE rule IS NULL) b ON a.symbol = b.symbol AND a.ts = b.ts),
ev AS (SELECT 1 AS run_id, rule AS "check", 'error' AS severity, 'excluded' AS action, symbol, ts, 1 AS bars, CAST(NULL AS DOUBLE) AS value FROM c1 WHERE rule IS NOT NULL
  UNION ALL SELECT 2, rule, 'error', 'excluded', symbol, ts, 1, NULL FROM c2 WHERE rule IS NOT NULL
  UNION ALL SELECT 2, 'bar_revised', 'warning', 'updated', symbol, ts, 1, raws FROM mg WHERE NOT ins AND NOT kept AND raws > 0
  UNION ALL SELECT 2, 'adj_close_restated', 'info', 'updated', symbol, min(ts), count(*), max(moved) FROM mg WHERE NOT ins AND NOT kept AND raws = 0 AND adj GROUP BY symbol)"""
_ISSUES = """(SELECT '{' || string_agg('"' || "check" || '":' || n, ',' ORDER BY "check") || '}' FROM (SELECT "check", count(*) AS n FROM ev WHERE ev.run_id = {0} GROUP BY "check"))"""
_DAYS = "(SELECT DISTINCT ts AS day FROM {0})"
SRC_22_SQL = f"""WITH {RUNS}
SELECT 1 AS run_id, 'succeeded' AS status, (SELECT count(*) FROM c1) AS bars_received, (SELECT count(*) FROM c1 WHERE rule IS NULL) AS bars_inserted, 0 AS bars_updated, 0 AS bars_unchanged, (SELECT count(rule) FROM c1) AS bars_excluded, 0 AS noise_ignored,
       (SELECT count(DISTINCT ts) FROM d1) AS sessions_upserted, {_ISSUES.replace('{0}', '1')} AS issues
UNION ALL SELECT 2, 'succeeded', (SELECT count(*) FROM c2), count(*) FILTER (ins), count(*) FILTER (NOT ins AND NOT kept AND (raws > 0 OR adj)), count(*) FILTER (NOT ins AND NOT kept AND raws = 0 AND NOT adj), (SELECT count(rule) FROM c2), count(*) FILTER (NOT ins AND NOT kept AND raws = 0 AND NOT adj AND other),
       (SELECT count(*) FROM {_DAYS.format('d2')} WHERE day(day) > 15 OR day NOT IN (SELECT ts FROM d1)), {_ISSUES.replace('{0}', '2')} FROM mg"""
SRC_24_SQL = f"WITH {RUNS} SELECT 2 AS run_id, (SELECT count(*) FROM c2) AS bars_received, (SELECT count(rule) FROM c2) AS bars_excluded"
SRC_25_SQL = f"""WITH {RUNS} SELECT run_id, "check", severity, action, symbol, ts, bars, {sql.settled('value', 'value')} FROM ev WHERE run_id > 1 AND ts >= TIMESTAMP '1995-01-01'"""
AGG_44_SQL = f"""WITH {RUNS} SELECT run_id, "check", count(*) AS n, CAST(sum(bars) AS BIGINT) AS bars FROM ev GROUP BY run_id, "check" """
STM_12_SQL = f"""WITH {RUNS} SELECT 'DATA_INGESTION_FAILED' AS kind, 'critical' AS severity, 1 AS n, 1 AS subjects
UNION ALL SELECT 'DATA_QUALITY_EVENT', CASE severity WHEN 'error' THEN 'critical' ELSE severity END, count(*), count(DISTINCT symbol || ' ' || "check") FROM ev GROUP BY 2"""


def stm_09_strategy_alerts(spark, sf_dir):
    """Changes of state of the rule strategies that are alerts."""
    rules = (strategies.BUY_AND_HOLD, strategies.SMA_TREND, strategies.SMA_CROSSOVER)
    found = ingestion.transition_alerts(strategies.states(windowed(item_bars(spark, sf_dir)), rules))
    return found.select("symbol", "strategy", "ts", "previous", "current", F.length("alert_id").alias("id_length"))


STM_09_SQL = f"""WITH {sql.BARS}, m AS (SELECT symbol, ts, close, {sql.full('avg(close)', 'close', 200)} AS s200, {sql.full('avg(close)', 'close', 20)} AS s20, {sql.full('avg(close)', 'close', 50)} AS s50 FROM bars),
s AS (SELECT symbol, ts, 'buy_and_hold' AS strategy, 'LONG' AS state FROM m UNION ALL SELECT symbol, ts, 'sma_trend', CASE WHEN s200 IS NULL THEN 'INSUFFICIENT_DATA' WHEN close > s200 THEN 'LONG' ELSE 'FLAT' END FROM m
  UNION ALL SELECT symbol, ts, 'sma_crossover', CASE WHEN s50 IS NULL THEN 'INSUFFICIENT_DATA' WHEN s20 > s50 THEN 'LONG' ELSE 'FLAT' END FROM m),
p AS (SELECT *, lag(state) OVER (PARTITION BY symbol, strategy ORDER BY ts) AS previous FROM s)
SELECT symbol, strategy, ts, previous, state AS current, 64 AS id_length FROM p WHERE previous <> state AND state <> 'INSUFFICIENT_DATA'"""

# frozen files


def src_07_price_csv(spark, sf_dir):
    """Bars of one symbol written as a file and read back up to a day."""
    path = fresh_folder(spark, "prices")
    b = item_bars(spark, sf_dir).where("symbol = 'A'")
    b.select(F.lit("x").alias("note"), "volume", F.date_format("ts", "yyyy-MM-dd").alias("date"), *[c for c in frozen.PRICES if c not in ("volume", "dividends", "splits")], F.lit(0.0).alias("dividends"), F.lit(0.0).alias("splits")).write.option("header", True).csv(path)
    return rounded(frozen.price_csv(spark, path, "1996-06-30").select(F.col("date").cast("timestamp_ntz").alias("ts"), *[c for c in frozen.PRICES]))


SRC_07_SQL = f"WITH {sql.BARS} SELECT ts, {sql.all_settled('open high low close adj_close volume')}, 0.0::DOUBLE AS dividends, 0.0::DOUBLE AS splits FROM bars WHERE symbol = 'A' AND ts <= TIMESTAMP '1996-06-30'"


def src_08_rate_csv(spark, sf_dir):
    """The mean price of a day's orders as observations."""
    path = fresh_folder(spark, "rates")
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("v"))
    o.select(F.lit("D.EUR").alias("KEY"), F.date_format("d", "yyyy-MM-dd").alias("TIME_PERIOD"), F.col("v").alias("OBS_VALUE"), F.lit("A, B").alias("OBS_STATUS")).write.option("header", True).csv(path)
    return rounded(frozen.rate_csv(spark, path, "1997-12-31").select(F.col("date").cast("timestamp_ntz").alias("ts"), "value"), 4)


SRC_08_SQL = f"SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, {sql.settled('avg(o_totalprice)', 'value', 4)} FROM orders WHERE date_trunc('day', o_orderdate) <= TIMESTAMP '1997-12-31' GROUP BY 1"


def flt_38_chronology(spark, sf_dir):
    """Whether training rows come first: by symbol, and with an odd day of each month taken for training."""
    rows = features.assemble(item_bars(spark, sf_dir)).where("period <> 'purged'")
    mixed = rows.withColumn("period", F.when(F.dayofmonth("ts") == 17, "train").otherwise(F.col("period")))
    split = frozen.chronology(rows, "period", "train", "ts", "symbol").withColumn("split", F.lit("by time"))
    return split.unionByName(frozen.chronology(mixed, "period", "train", "ts", "symbol").withColumn("split", F.lit("mixed")))


_PERIODS = f"""{sql.BARS}, i AS (SELECT symbol, ts, row_number() OVER ({sql.W}) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
pr AS (SELECT symbol, ts, CASE WHEN i <= floor(n * 0.6) - 1 THEN 'train' WHEN i <= floor(n * 0.6) THEN 'purged' WHEN i <= floor(n * 0.8) - 1 THEN 'validation' WHEN i <= floor(n * 0.8) THEN 'purged' ELSE 'test' END AS period FROM i),
al AS (SELECT 'by time' AS split, symbol, ts, period = 'train' AS t FROM pr WHERE period <> 'purged' UNION ALL SELECT 'mixed', symbol, ts, period = 'train' OR day(ts) = 17 FROM pr WHERE period <> 'purged')"""
FLT_38_SQL = f"""WITH {_PERIODS}, g AS (SELECT split, symbol, max(ts) FILTER (t) AS last, min(ts) FILTER (NOT t) AS first FROM al GROUP BY ALL) SELECT split, symbol, last, first, coalesce(last < first, true) AS ordered FROM g"""


def view_28_universe(spark, sf_dir):
    """Rules that a universe of the parts' brands breaks, with legs of the nations."""
    p = table(spark, sf_dir, "part")
    assets = p.groupBy(F.col("p_brand").alias("id")).agg(F.min("p_type").alias("symbol"), F.when(F.max("p_size") > 45, "proxy").otherwise("index").alias("kind"), F.min("p_type").alias("tracks"), F.min_by("p_type", F.struct("p_size", "p_partkey")).alias("product_tracks"), F.concat(F.lit("class "), (F.count("*") % 3).cast("string")).alias("cost_class"))
    n = table(spark, sf_dir, "nation")
    legs = n.where("n_nationkey < 6").select(F.concat(F.lit("Brand#1"), F.col("n_nationkey").cast("string")).alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Brand#"), F.col("n_nationkey") + 10)).alias("same_as"), F.col("n_name").alias("symbol"), F.lit(0.2).alias("weight"))
    classes = spark.createDataFrame([("class 0",), ("class 1",)], "cost_class string")
    return frozen.universe_violations(assets, legs, classes)


VIEW_28_SQL = """WITH a AS (SELECT p_brand AS id, min(p_type) AS symbol, CASE WHEN max(p_size) > 45 THEN 'proxy' ELSE 'index' END AS kind, min(p_type) AS tracks, arg_min(p_type, row(p_size, p_partkey)) AS product_tracks, 'class ' || (count(*) % 3) AS cost_class FROM part GROUP BY p_brand),
l AS (SELECT 'Brand#1' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'Brand#' || (n_nationkey + 10) END AS same_as, n_name AS symbol, 0.2 AS weight FROM nation WHERE n_nationkey < 6),
s AS (SELECT id, symbol FROM a UNION ALL SELECT id, symbol FROM l WHERE same_as IS NULL)
SELECT 'asset_count' AS rule, CAST(count(*) AS VARCHAR) AS subject FROM a HAVING count(*) NOT BETWEEN 4 AND 8
UNION ALL SELECT 'duplicate_symbol', symbol FROM s GROUP BY symbol HAVING count(*) <> 1
UNION ALL SELECT 'unknown_cost_class', id || ' ' || cost_class FROM a WHERE cost_class NOT IN ('class 0', 'class 1')
UNION ALL SELECT 'series_differs', id FROM a WHERE kind = 'proxy' AND tracks IS DISTINCT FROM product_tracks
UNION ALL SELECT 'leg_weights', CAST(round(sum(weight), 9)::DOUBLE AS VARCHAR) FROM l HAVING abs(round(sum(weight), 9) - 1) > 1e-12
UNION ALL SELECT 'unknown_asset', same_as FROM l WHERE same_as IS NOT NULL AND same_as NOT IN (SELECT id FROM a)
UNION ALL SELECT 'leg_id_clashes', id FROM l WHERE same_as IS NULL AND id IN (SELECT id FROM a)"""

QUERIES = {f.__name__: f for f in (src_22_ingestion, src_24_latest_run, src_25_events_since, agg_44_issues, stm_12_quality_alerts, stm_09_strategy_alerts, src_07_price_csv, src_08_rate_csv, flt_38_chronology, view_28_universe)}
SQL = dict(zip(QUERIES, (SRC_22_SQL, SRC_24_SQL, SRC_25_SQL, AGG_44_SQL, STM_12_SQL, STM_09_SQL, SRC_07_SQL, SRC_08_SQL, FLT_38_SQL, VIEW_28_SQL), strict=True))
