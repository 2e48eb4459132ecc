"""Queries of scalar rules, small views and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import calendar, scalars
from tidemark.functions.semantics import correlation, rounded
from tidemark.operators import features, ledger, portfolio, strategies, structure, trees
from tidemark.plans import sql
from tidemark.plans.indicator_queries import SWING_CTE
from tidemark.plans.price_queries import FEATURES
from tidemark.sources.bars import five_minute_quotes, item_bars, quotes, table
from tidemark.sources.shared import fresh_folder
from tidemark.streaming import bars as streaming
from tidemark.streaming import revisions


def fn_01_scores(spark, sf_dir):
    """Scores of candles (FN-01 to 04): bodies at least and at most so large, ranges by logarithm, and the mean of what is defined."""
    b = item_bars(spark, sf_dir).withColumns({"body": F.try_divide(F.abs(F.col("close") - F.col("open")), F.col("high") - F.col("low")), "reach": F.try_divide("high", "low")})
    b = b.withColumns({"large": scalars.at_least(F.col("body"), 0.3, 0.8), "small": scalars.at_most(F.col("body"), 0.5, 0.1), "wide": scalars.log_score(F.col("reach") - 1, 2.0)})
    return rounded(b.select("symbol", "ts", "large", "small", "wide", scalars.mean_of(F.col("large"), F.when(F.col("volume") > 200, F.col("small")), F.col("wide")).alias("mean")))


_CLIP = lambda x: f"greatest(0.0, least(1.0, {x}))"
FN_01_SQL = f"""WITH {sql.BARS}, b AS (SELECT *, abs(close - open) / nullif(high - low, 0) AS body, high / nullif(low, 0) - 1 AS r FROM bars),
s AS (SELECT symbol, ts, volume, CASE WHEN body IS NOT NULL THEN {_CLIP('(body - 0.3) / (0.8 - 0.3)')} END AS large, CASE WHEN body IS NOT NULL THEN {_CLIP('(0.5 - body) / (0.5 - 0.1)')} END AS small, CASE WHEN r > 0 THEN {_CLIP('ln(r) / ln(2.0)')} END AS wide FROM b)
SELECT symbol, ts, {sql.all_settled('large small wide')}, {sql.settled('list_avg(list_filter([large, CASE WHEN volume > 200 THEN small END, wide], lambda v: v IS NOT NULL))', 'mean')} FROM s"""


def fn_06_day_bounds(spark, sf_dir):
    """Bounds of each event hour's trading day, whether the market is open, and when it next opens; the tenth of each month is a holiday."""
    e = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).distinct()
    days = e.select(F.explode(F.sequence(F.date_sub(calendar.trading_day(F.col("ts")), 1), F.date_add(calendar.trading_day(F.col("ts")), 8))).alias("day")).distinct()
    holidays = days.where(F.dayofmonth("day") == 10)
    return calendar.day_bounds(e, holidays)


FN_06_SQL = """WITH e AS (SELECT DISTINCT date_trunc('hour', ts)::TIMESTAMP AS ts FROM events), d AS (SELECT ts, CAST(timezone('America/New_York', timezone('UTC', ts)) + INTERVAL 7 HOUR AS DATE) AS day FROM e),
o AS (SELECT *, isodow(day) < 6 AND day(day) <> 10 AS open, (SELECT min(day + n::INT) FROM range(1, 8) AS t(n) WHERE isodow(day + n::INT) < 6 AND day(day + n::INT) <> 10) AS later FROM (SELECT ts, CAST(day AS DATE) AS day FROM d))
SELECT ts, day, timezone('UTC', timezone('America/New_York', day - INTERVAL 7 HOUR)) AS starts_at, timezone('UTC', timezone('America/New_York', day + INTERVAL 17 HOUR)) AS ends_at, open,
       CASE WHEN open THEN ts ELSE timezone('UTC', timezone('America/New_York', later - INTERVAL 7 HOUR)) END AS next_open FROM o"""


def fn_14_ids(spark, sf_dir):
    """Canonical texts of orders, their fingerprints and ids (FN-14 to 16)."""
    o = table(spark, sf_dir, "orders").withColumn("text", scalars.canonical({"status": F.col("o_orderstatus"), "customer": F.col("o_custkey"), "big": F.when(F.col("o_custkey") % 3 > 0, F.col("o_totalprice") > 100_000)}))
    return o.select("o_orderkey", "text", scalars.fingerprint_of(F.col("text")).alias("fingerprint"), ledger.short_id(F.lit("order"), F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), length=20).alias("id"))


FN_14_SQL = """WITH t AS (SELECT *, '{"big":' || coalesce(CASE WHEN o_custkey % 3 > 0 THEN CAST(o_totalprice > 100000 AS VARCHAR) END, 'null') || ',"customer":' || o_custkey || ',"status":"' || o_orderstatus || '"}' AS text FROM orders)
SELECT o_orderkey, text, substr(sha256(text), 1, 16) AS fingerprint, substr(sha256('order|' || o_orderkey || '|' || o_orderstatus), 1, 20) AS id FROM t"""


def src_26_fingerprint(spark, sf_dir):
    """Content of each symbol's bars in millionths, hashed by month and then over the months (SRC-27)."""
    b = item_bars(spark, sf_dir).select("symbol", F.date_format("ts", "yyyy-MM").alias("month"), F.date_format("ts", "yyyy-MM-dd").alias("day"), *[F.round(F.col(c) * 1e6 + 1e-3).cast("long").cast("string").alias(c) for c in ("open", "high", "low", "close")])
    return ledger.block_fingerprint(b, ("symbol",), "month", ("day",), ("open", "high", "low", "close"))


SRC_26_SQL = f"""WITH {sql.BARS}, h AS (SELECT symbol, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day, sha256(concat_ws('|', strftime(ts, '%Y-%m-%d'), {", ".join(f"CAST(CAST(round({c} * 1e6 + 1e-3) AS BIGINT) AS VARCHAR)" for c in ("open", "high", "low", "close"))})) AS h FROM bars),
m AS (SELECT symbol, month, count(*) AS n, sha256(string_agg(h, '' ORDER BY day)) AS h FROM h GROUP BY ALL) SELECT symbol, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(h, '' ORDER BY month)) AS fingerprint FROM m GROUP BY symbol"""


def src_32_hash_chain(spark, sf_dir):
    """A chain of each user's events, and how many of its records do not verify after every hundredth was edited."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("account"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), F.concat_ws(":", "event_id", "event_type").alias("record"))
    made = ledger.chain(e)
    edited = ledger.verify(made.withColumn("record", F.when(F.col("record").rlike("^\\d*00:"), "edited").otherwise(F.col("record")))).groupBy("account").agg(F.count("*").alias("broken"))
    return made.groupBy("account").agg(F.count("*").alias("n"), F.max_by("hash", "seq").alias("last_hash")).join(edited, "account", "left").fillna(0, ["broken"])


SRC_32_SQL = """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS account, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id || ':' || event_type AS record FROM events),
c AS (SELECT account, 0::BIGINT AS seq, repeat('0', 64) AS hash FROM (SELECT DISTINCT account FROM e) UNION ALL SELECT e.account, e.seq, sha256(c.hash || '|' || e.seq || '|' || e.record) FROM c JOIN e ON e.account = c.account AND e.seq = c.seq + 1)
SELECT c.account, max(c.seq) AS n, arg_max(c.hash, c.seq) AS last_hash, (SELECT count(*) FROM e WHERE e.account = c.account AND regexp_matches(record, '^[0-9]*00:')) AS broken FROM c GROUP BY c.account"""


def fn_23_costs(spark, sf_dir):
    """Commission within bounds, an order's costs, what cash buys with its own costs, the price that a budget allows, and weights (FN-23 to 26, 28)."""
    line = table(spark, sf_dir, "lineitem")
    costs = portfolio.Costs(commission_bps=5.0, minimum=3.0)
    n = F.col("l_extendedprice")
    return rounded(
        line.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", n.alias("notional"), scalars.commission(n, 0.0007, 5.0, 25.0).alias("commission"), portfolio.order_costs(n, costs).alias("costs"), portfolio.buy_notional(n, costs).alias("buys"),
            scalars.limit_price(n, F.col("l_quantity")).cast("double").alias("limit_price"), scalars.target_weight(4, 0.05, F.col("l_tax")).alias("weight"),
        ),
        4,
    )


FN_23_SQL = f"""WITH c AS (SELECT *, l_extendedprice AS n, (l_extendedprice - 1.0) / (1 + 3e-4 + 5e-4) AS usual FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sql.settled('n', 'notional', 4)}, {sql.settled('least(25.0, greatest(5.0, n * 0.0007))', 'commission', 4)}, {sql.settled('greatest(1.0 + n * 5e-4, 3.0) + n * 1e-4 + n * 2e-4', 'costs', 4)},
  {sql.settled('CASE WHEN 1.0 + usual * 5e-4 < 3.0 THEN (n - 3.0) / (1 + 3e-4) ELSE usual END', 'buys', 4)}, {sql.settled('(CAST(round(n * 10000) AS HUGEINT) // (CAST(l_quantity AS HUGEINT) * 100))::DOUBLE / 100', 'limit_price', 4)}, {sql.settled('CASE WHEN l_tax > 0 THEN least(1.0, 0.05 / l_tax) / 4 END', 'weight', 4)} FROM c"""


def str_18_states(spark, sf_dir):
    """States of a model's probabilities; undefined features leave no state."""
    from tidemark.plans.tree_queries import CENTER, SCALE, WEIGHTS

    p = trees.linear(WEIGHTS, 0.1, CENTER, SCALE, True)
    return features.assemble(item_bars(spark, sf_dir)).select("symbol", "ts", scalars.state_of(p).alias("state"))


def _linear_sql():
    from tidemark.plans.tree_queries import _Z

    return f"WITH {FEATURES}, z AS (SELECT symbol, ts, 0.1 + {_Z} AS z FROM f) SELECT symbol, ts, CASE WHEN z IS NULL THEN 'INSUFFICIENT_DATA' WHEN z > 0 THEN 'LONG' ELSE 'FLAT' END AS state FROM z"


def stm_21_fresh_quotes(spark, sf_dir):
    """Quotes of the last twelve hours at a given time."""
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    q = quotes(spark, sf_dir).where(F.col("ts") <= now)
    return rounded(streaming.fresh(q, now, 43_200).select("symbol", "ts", "event_id", "bid", "ask"))


STM_21_SQL = f"WITH {sql.QUOTES} SELECT symbol, ts, event_id, {sql.all_settled('bid ask')} FROM quotes WHERE ts <= TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-19 12:00:00'"


def stm_02_last_bars(spark, sf_dir):
    """The last 600 five-minute bars of each symbol."""
    return rounded(streaming.last_bars(five_minute_quotes(spark, sf_dir), 600))


STM_02_SQL = f"WITH {sql.M5} SELECT symbol, ts, {sql.all_settled('open high low close')} FROM m5 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 600"


def stm_06_exactly_once(spark, sf_dir):
    """Events that a keyed sink holds after their stream ran twice from the start."""
    root = fresh_folder(spark, "once")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"), F.floor(F.dayofmonth("ts") / 11).cast("int").alias("arrival"))
    revisions.write_arrivals(e, f"{root}/in", "arrival")
    sink = streaming.keyed_sink(spark, f"{root}/out", ("event_id",))
    for attempt in range(2):
        stream = revisions.replayed(spark, f"{root}/in", "symbol string, ts timestamp, event_id long, price double")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint-{attempt}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "price")


STM_06_SQL = "SELECT event_type AS symbol, ts, event_id, value AS price FROM events"


def flt_34_known_swings(spark, sf_dir):
    """Swings confirmed by a day, in the order of their ids (TOPK-02)."""
    found = structure.swings(item_bars(spark, sf_dir))
    return rounded(found.where(F.col("confirmed_at") <= F.lit("1995-12-31").cast("timestamp_ntz")))


FLT_34_SQL = f"WITH {sql.BARS}, {SWING_CTE} SELECT symbol, ts, idx, kind, confirmed_at, confirmed_idx, swing_id, label, {sql.all_settled('price change_pct')} FROM swings WHERE confirmed_at <= TIMESTAMP '1995-12-31'"


def src_15_api_bars(spark, sf_dir):
    """Bars that come as JSON texts, as a typed frame; times in several notations (VIEW-05)."""
    e = table(spark, sf_dir, "events")
    stamp = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00")))
    sent = e.select(F.to_json(F.struct(F.col("event_type").alias("s"), stamp.alias("t"), F.col("value").alias("c"), F.col("event_id").alias("n"))).alias("text"))
    typed = sent.select(F.from_json("text", "s string, t string, c double, n long").alias("b"))
    return rounded(typed.select(F.col("b.s").alias("symbol"), scalars.iso_time(F.col("b.t")).cast("timestamp_ntz").alias("ts"), F.col("b.c").alias("close"), F.col("b.n").alias("event_id")))


SRC_15_SQL = f"SELECT event_type AS symbol, CASE event_id % 3 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN ts ELSE date_trunc('millisecond', ts) END::TIMESTAMP AS ts, {sql.settled('value', 'close')}, event_id FROM events"


def udf_01_plug_in(spark, sf_dir):
    """A strategy that a user declares: long after a close in the upper half of the range."""
    own = strategies.Strategy("upper_half", ("close", "high", "low"), lambda c, h, lo: (c.isNull() | (h <= lo), c > (h + lo) / 2))
    return strategies.summary(strategies.states(item_bars(spark, sf_dir), (own,)))


UDF_01_SQL = f"""WITH {sql.BARS}, s AS (SELECT symbol, ts, 'upper_half' AS strategy, CASE WHEN high <= low THEN 'INSUFFICIENT_DATA' WHEN close > (high + low) / 2 THEN 'LONG' ELSE 'FLAT' END AS state FROM bars), p AS (SELECT *, lag(state) OVER ({sql.W}) AS was FROM s)
SELECT symbol, strategy, count(*) AS bars, count(*) FILTER (state = 'LONG') AS long, count(*) FILTER (state = 'FLAT') AS flat, count(*) FILTER (state = 'INSUFFICIENT_DATA') AS insufficient, count(*) FILTER (state <> was) AS changes, min(ts) FILTER (state <> 'INSUFFICIENT_DATA') AS first_decided FROM p GROUP BY symbol, strategy"""


def topk_05_importances(spark, sf_dir):
    """The four features of each symbol that go most with its target, by the size of their correlation."""
    rows = features.assemble(item_bars(spark, sf_dir)).where("target is not null")
    one = rows.select("symbol", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("x"), F.col("target").cast("double").alias("y")) for n in features.NAMES])).alias("f")).select("symbol", "f.*").where("x is not null")
    found = one.groupBy("symbol", "feature").agg(F.round(correlation("x", "y"), 9).alias("weight"))
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(F.abs("weight")), "feature"))
    return rounded(found.withColumn("place", place).where("place <= 4"))


TOPK_05_SQL = f"""WITH {FEATURES}, u AS (UNPIVOT (SELECT symbol, target::DOUBLE AS y, {", ".join(features.NAMES)} FROM f WHERE target IS NOT NULL) ON {", ".join(features.NAMES)} INTO NAME feature VALUE x),
c AS (SELECT symbol, feature, round(corr(x, y), 9) AS weight FROM u WHERE x IS NOT NULL GROUP BY ALL)
SELECT symbol, feature, {sql.settled('weight', 'weight')}, row_number() OVER (PARTITION BY symbol ORDER BY abs(weight) DESC, feature) AS place FROM c QUALIFY place <= 4"""


def topk_11_recent(spark, sf_dir):
    """The last fifty events, the oldest first as they are read."""
    last = table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(50)
    return last.select("event_id", "ts", "event_type").orderBy("event_id")


TOPK_11_SQL = "SELECT event_id, ts, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 50) ORDER BY event_id"


def fn_18_one_hot(spark, sf_dir):
    """States as numbers, and rows as JSON without NaN (FN-32)."""
    b = item_bars(spark, sf_dir)
    state = F.when(F.col("close") > F.col("open"), "up").when(F.col("close") < F.col("open"), "down").otherwise("flat")
    ratio = F.when(F.col("volume") > 100, F.round((F.col("close") > F.col("open")).cast("double"), 1)).otherwise(float("nan"))
    b = b.withColumns({"state": state, "r": scalars.without_nan(ratio)})
    return b.select("symbol", "ts", *[(F.col("state") == v).cast("double").alias(v) for v in ("up", "down", "flat")], F.to_json(F.struct("state", "r")).alias("text"))


FN_18_SQL = f"""WITH {sql.BARS}, s AS (SELECT *, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS state FROM bars)
SELECT symbol, ts, (state = 'up')::INT::DOUBLE AS up, (state = 'down')::INT::DOUBLE AS down, (state = 'flat')::INT::DOUBLE AS flat, '{{"state":"' || state || '"' || CASE WHEN volume > 100 THEN ',"r":' || CASE WHEN close > open THEN '1.0' ELSE '0.0' END ELSE '' END || '}}' AS text FROM s"""


def view_07_slice_sessions(spark, sf_dir):
    """Sessions of each slice by the day in New York, and the one bar of a session that is looked up (VIEW-06)."""
    b = item_bars(spark, sf_dir).withColumn("day", F.to_date(calendar.local(F.col("ts"), "America/New_York")))
    slices = spark.createDataFrame([("1993", "1993-01-01", "1993-12-31"), ("1995 on", "1995-01-01", "2030-01-01")], "slice string, a string, z string").select("slice", F.col("a").cast("date").alias("a"), F.col("z").cast("date").alias("z"))
    inside = b.join(F.broadcast(slices), F.col("day").between(F.col("a"), F.col("z")))
    return inside.groupBy("symbol", "slice").agg(F.count("*").alias("bars"), F.count_distinct("day").alias("sessions"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"))


VIEW_07_SQL = f"""WITH {sql.BARS}, b AS (SELECT symbol, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS day FROM bars), s(slice, a, z) AS (VALUES ('1993', DATE '1993-01-01', DATE '1993-12-31'), ('1995 on', DATE '1995-01-01', DATE '2030-01-01'))
SELECT symbol, slice, count(*) AS bars, count(DISTINCT day) AS sessions, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day FROM b JOIN s ON day BETWEEN a AND z GROUP BY symbol, slice"""

QUERIES = {
    f.__name__: f
    for f in (
        fn_01_scores, fn_06_day_bounds, fn_14_ids, src_26_fingerprint, src_32_hash_chain, fn_23_costs, str_18_states, stm_21_fresh_quotes, stm_02_last_bars, stm_06_exactly_once, src_15_api_bars, udf_01_plug_in, topk_05_importances, topk_11_recent,
        fn_18_one_hot, view_07_slice_sessions, flt_34_known_swings,
    )
}
SQL = dict(zip(QUERIES, (FN_01_SQL, FN_06_SQL, FN_14_SQL, SRC_26_SQL, SRC_32_SQL, FN_23_SQL, _linear_sql(), STM_21_SQL, STM_02_SQL, STM_06_SQL, SRC_15_SQL, UDF_01_SQL, TOPK_05_SQL, TOPK_11_SQL, FN_18_SQL, VIEW_07_SQL, FLT_34_SQL), strict=True))
