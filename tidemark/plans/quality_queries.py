"""Queries of scans, data quality and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.semantics import by, rounded
from tidemark.operators import quality
from tidemark.plans import sql
from tidemark.sources.bars import closed_bars, item_bars, quotes, sessions, table

AS_OF = "1998-06-01"


def provider_rows(spark, sf_dir):
    """Order lines as a provider's rows, with faults by their quantities, and duplicates because keys repeat."""
    lines = table(spark, sf_dir, "lineitem")
    price, q = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity")
    fault = lambda n: q == n
    return lines.select(
        F.concat_ws("-", "l_returnflag", "l_linestatus", F.col("l_suppkey").cast("string")).alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.when(fault(1), None).otherwise(price).alias("open"), (price * F.when(fault(2), 0.5).otherwise(1 + F.col("l_discount"))).alias("high"), (price * (1 - F.col("l_tax"))).alias("low"),
        F.when(fault(3), -price).otherwise(price).alias("close"), F.when(fault(4), -q).when(fault(5), 0.0).otherwise(q).alias("volume"), F.when(fault(6), None).when(fault(7), 0.0).otherwise(price).alias("adj_close"),
    )


ROWS = """rows0 AS (SELECT l_returnflag || '-' || l_linestatus || '-' || l_suppkey AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS p, l_quantity AS q, l_discount AS d, l_tax AS t FROM lineitem),
rows1 AS (SELECT symbol, ts, CASE WHEN q <> 1 THEN p END AS open, p * CASE WHEN q = 2 THEN 0.5 ELSE 1 + d END AS high, p * (1 - t) AS low, CASE WHEN q = 3 THEN -p ELSE p END AS close,
  CASE WHEN q = 4 THEN -q WHEN q = 5 THEN 0.0 ELSE q END AS volume, CASE WHEN q = 6 THEN NULL WHEN q = 7 THEN 0.0 ELSE p END AS adj_close FROM rows0),
rows2 AS (SELECT *, count(*) OVER k AS n, row_number() OVER (PARTITION BY symbol, ts, open, high, low, close, volume, adj_close) AS same_place,
  count(*) OVER (PARTITION BY symbol, ts, open, high, low, close, volume, adj_close) AS same FROM rows1 WINDOW k AS (PARTITION BY symbol, ts)),
checked AS (SELECT symbol, ts, open, high, low, close, volume, adj_close, CASE WHEN same <> n THEN 'conflicting_duplicate_bar' WHEN same_place > 1 THEN 'duplicate_bar' WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL THEN 'null_value'
  WHEN least(open, high, low, close) <= 0 THEN 'non_positive_price' WHEN adj_close <= 0 THEN 'non_positive_adj_close' WHEN high + 1e-6 < greatest(open, close, low) OR low - 1e-6 > least(open, close, high) THEN 'ohlc_inconsistent'
  WHEN volume < 0 THEN 'negative_volume' WHEN ts > TIMESTAMP '1998-06-01' THEN 'future_bar' END AS rule FROM rows2)"""


def validated(spark, sf_dir):
    return quality.validate(provider_rows(spark, sf_dir), F.lit(AS_OF).cast("timestamp_ntz"))


def flt_02_rules(spark, sf_dir):
    return validated(spark, sf_dir).groupBy(F.coalesce("rule", F.lit("accepted")).alias("rule")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.countDistinct("symbol").alias("symbols"))


FLT_02_SQL = f"WITH {ROWS} SELECT coalesce(rule, 'accepted') AS rule, count(*) AS n, min(ts) AS first_ts, count(DISTINCT symbol) AS symbols FROM checked GROUP BY 1"


def flt_04_accepted(spark, sf_dir):
    return rounded(quality.accept(validated(spark, sf_dir)))


FLT_04_SQL = f"WITH {ROWS} SELECT symbol, ts, {sql.all_settled('open high low close volume adj_close')} FROM checked WHERE rule IS NULL"


def flt_11_flags(spark, sf_dir):
    accepted, turn = quality.accept(validated(spark, sf_dir)), F.lit("1995-01-01").cast("timestamp_ntz")
    split = F.when((F.col("ts") >= turn) & (F.lag("ts").over(by()) < turn), 2.0).otherwise(0.0)
    flags = quality.flags(accepted.withColumn("split_ratio", split))
    return rounded(flags.groupBy("check").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")))


FLT_11_SQL = f"""WITH {ROWS}, a AS (SELECT *, lag(ts) OVER ({sql.W}) AS ts1, lag(close) OVER ({sql.W}) AS c1, adj_close / close AS f, lag(adj_close / close) OVER ({sql.W}) AS f1 FROM checked WHERE rule IS NULL),
x AS (SELECT 'zero_volume' AS "check", volume AS v FROM a WHERE volume = 0 UNION ALL SELECT 'missing_adj_close', NULL FROM a WHERE adj_close IS NULL UNION ALL SELECT 'split_detected', 2.0 FROM a WHERE ts >= TIMESTAMP '1995-01-01' AND ts1 < TIMESTAMP '1995-01-01' UNION ALL SELECT 'return_outlier', close / c1 - 1 FROM a WHERE abs(close / c1 - 1) > 0.1
  UNION ALL SELECT 'gap_outlier', open / c1 - 1 FROM a WHERE abs(open / c1 - 1) > 0.07 UNION ALL SELECT 'adj_factor_decrease', f / f1 - 1 FROM a WHERE f / f1 - 1 < -1e-4)
SELECT "check", count(*) AS n, {sql.settled('min(v)', 'least')}, {sql.settled('max(v)', 'most')} FROM x GROUP BY 1"""


def flt_12_outliers(spark, sf_dir):
    return rounded(quality.flags(item_bars(spark, sf_dir)).where(F.col("check").isin("return_outlier", "gap_outlier")))


FLT_12_SQL = f"""WITH {sql.BARS}, a AS (SELECT *, lag(close) OVER ({sql.W}) AS c1 FROM bars)
SELECT symbol, ts, 'return_outlier' AS "check", {sql.settled('close / c1 - 1', 'value')} FROM a WHERE abs(close / c1 - 1) > 0.1 UNION ALL SELECT symbol, ts, 'gap_outlier', {sql.settled('open / c1 - 1')} FROM a WHERE abs(open / c1 - 1) > 0.07"""


def flt_15_missing(spark, sf_dir):
    found = quality.gaps(provider_rows(spark, sf_dir).select("symbol", "ts"), sessions(item_bars(spark, sf_dir)))
    return found.groupBy("symbol").agg(F.sum("n").alias("n"), F.min("first").alias("first_missing"))


FLT_15_SQL = f"""WITH {sql.BARS}, {ROWS}, b AS (SELECT DISTINCT symbol, ts FROM rows1), span AS (SELECT symbol, min(ts) AS a, max(ts) AS z FROM b GROUP BY symbol), cal AS (SELECT DISTINCT ts FROM bars)
SELECT symbol, count(*) AS n, min(ts) AS first_missing FROM (SELECT symbol, ts FROM span JOIN cal ON ts BETWEEN a AND z EXCEPT SELECT symbol, ts FROM b) GROUP BY symbol"""


def versions(spark, sf_dir):
    """Stored bars, and a later delivery: R is new, quiet days of N are revised, adj_close of 1995 is restated or noisy."""
    bars = item_bars(spark, sf_dir)
    stored = bars.where("symbol <> 'R'")
    year, shift = F.year("ts"), F.when(F.month("ts") == 1, 1.01).when(F.month("ts") == 2, 1 + 1e-7).otherwise(1.0)
    incoming = bars.where(year >= 1994).withColumns({"volume": F.when((F.col("symbol") == "N") & (F.col("volume") < 100), F.col("volume") + 1).otherwise(F.col("volume")), "adj_close": F.col("adj_close") * F.when(year == 1995, shift).otherwise(1.0)})
    return stored, incoming


def src_18_upsert(spark, sf_dir):
    return quality.revisions(*versions(spark, sf_dir)).groupBy("symbol", "outcome").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


SRC_18_SQL = f"""WITH {sql.BARS}, s AS (SELECT * FROM bars WHERE symbol <> 'R'), i AS (SELECT symbol, ts, open, high, low, close, CASE WHEN symbol = 'N' AND volume < 100 THEN volume + 1 ELSE volume END AS volume,
  adj_close * CASE WHEN year(ts) = 1995 THEN CASE month(ts) WHEN 1 THEN 1.01::DOUBLE WHEN 2 THEN 1 + 1e-7 ELSE 1.0 END ELSE 1.0 END AS adj_close FROM bars WHERE year(ts) >= 1994),
j AS (SELECT coalesce(s.symbol, i.symbol) AS symbol, coalesce(s.ts, i.ts) AS ts, CASE WHEN s.symbol IS NULL THEN 'inserted' WHEN i.symbol IS NULL THEN 'kept' WHEN s.volume IS DISTINCT FROM i.volume OR s.close IS DISTINCT FROM i.close THEN 'revised'
  WHEN abs(i.adj_close / s.adj_close - 1) > 1e-5 THEN 'adj_close_restated' ELSE 'unchanged' END AS outcome FROM s FULL JOIN i ON s.symbol = i.symbol AND s.ts = i.ts)
SELECT symbol, outcome, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM j GROUP BY 1, 2"""


def src_01_closed_bars(spark, sf_dir):
    return rounded(closed_bars(item_bars(spark, sf_dir), "A", "1994-01-01", "1996-12-31"))


SRC_01_SQL = f"WITH {sql.BARS} SELECT symbol, ts, {sql.all_settled('open high low close volume adj_close')} FROM bars WHERE symbol = 'A' AND ts BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31'"


def src_20_decimals(spark, sf_dir):
    """Stored form of prices and volume; the digits of a double that lie half-way go away from zero."""
    b = item_bars(spark, sf_dir)
    return b.select("symbol", "ts", F.col("close").cast("decimal(18,6)").alias("close"), F.col("volume").cast("decimal(28,8)").alias("volume"))


SRC_20_SQL = f"WITH {sql.BARS} SELECT symbol, ts, CAST(CAST(close AS VARCHAR) AS DECIMAL(18,6)) AS close, CAST(volume AS DECIMAL(28,8)) AS volume FROM bars"


def src_23_identity(spark, sf_dir):
    return item_bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


SRC_23_SQL = f"WITH {sql.BARS} SELECT symbol, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY symbol"


def src_41_last_sessions(spark, sf_dir):
    from pyspark.sql import Window

    latest = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return rounded(item_bars(spark, sf_dir).withColumn("i", F.row_number().over(latest)).where("i <= 63").drop("i", "adj_close"))


SRC_41_SQL = f"WITH {sql.BARS} SELECT symbol, ts, {sql.all_settled('open high low close volume')} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 63"


def src_14_chunks(spark, sf_dir):
    """Week ends that cover the events backwards from the last day."""
    span = table(spark, sf_dir, "events").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("z"))
    return span.select(F.explode(F.sequence("z", "a", F.expr("interval -7 days"))).alias("chunk_end"))


SRC_14_SQL = "SELECT CAST(unnest(generate_series(z, a, INTERVAL '-7 days')) AS DATE) AS chunk_end FROM (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS z FROM events)"


def src_09_bid_ask(spark, sf_dir):
    """Hourly bars of both sides, joined on their time, with the mid."""
    from tidemark.sources.bars import resample

    q = quotes(spark, sf_dir)
    side = lambda s: resample(q.select("symbol", "ts", F.col(s).alias("price")), 3600).select("symbol", "ts", *[F.col(c).alias(f"{s}_{c}") for c in ("open", "high", "low", "close")])
    both = side("bid").join(side("ask"), ["symbol", "ts"])
    return rounded(both.withColumns({f"mid_{c}": (F.col(f"bid_{c}") + F.col(f"ask_{c}")) / 2 for c in ("open", "high", "low", "close")}))


def _side(s):
    return f"{s}s AS (SELECT symbol, date_trunc('hour', quotes.ts) AS ts, arg_min({s}, quotes.ts) AS {s}_open, max({s}) AS {s}_high, min({s}) AS {s}_low, arg_max({s}, quotes.ts) AS {s}_close FROM quotes GROUP BY symbol, date_trunc('hour', quotes.ts))"


SRC_09_SQL = f"WITH {sql.QUOTES}, {_side('bid')}, {_side('ask')} SELECT bids.symbol, bids.ts, {sql.all_settled(' '.join(f'{s}_{c}' for s in ('bid', 'ask') for c in ('open', 'high', 'low', 'close')))}, " + ", ".join(sql.settled(f"(bid_{c} + ask_{c}) / 2", f"mid_{c}") for c in ("open", "high", "low", "close")) + " FROM bids JOIN asks ON bids.symbol = asks.symbol AND bids.ts = asks.ts"

QUERIES = {
    "flt_02_rules": flt_02_rules, "flt_04_accepted": flt_04_accepted, "flt_11_flags": flt_11_flags, "flt_12_outliers": flt_12_outliers, "flt_15_missing": flt_15_missing, "src_18_upsert": src_18_upsert, "src_01_closed_bars": src_01_closed_bars,
    "src_20_decimals": src_20_decimals, "src_23_identity": src_23_identity, "src_41_last_sessions": src_41_last_sessions, "src_14_chunks": src_14_chunks, "src_09_bid_ask": src_09_bid_ask,
}
SQL = {
    "flt_02_rules": FLT_02_SQL, "flt_04_accepted": FLT_04_SQL, "flt_11_flags": FLT_11_SQL, "flt_12_outliers": FLT_12_SQL, "flt_15_missing": FLT_15_SQL, "src_18_upsert": SRC_18_SQL, "src_01_closed_bars": SRC_01_SQL,
    "src_20_decimals": SRC_20_SQL, "src_23_identity": SRC_23_SQL, "src_41_last_sessions": SRC_41_SQL, "src_14_chunks": SRC_14_SQL, "src_09_bid_ask": SRC_09_SQL,
}
