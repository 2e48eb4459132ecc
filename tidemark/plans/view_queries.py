"""Queries of read-side views, alerts, weights, gates and further market rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.functions.semantics import asof, by, full, lagged, rounded, running, trailing, with_runs
from tidemark.plans import sql
from tidemark.sources.bars import item_bars, sessions, table

W = sql.W


def flt_01_normalise(spark, sf_dir):
    """Provider times as local dates in New York, matched with sessions; what has none is kept as a reject."""
    rows = table(spark, sf_dir, "events").select("event_id", F.to_date(calendar.local(F.col("ts"), "America/New_York")).alias("day"))
    held = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("ts")).groupBy("day").agg(F.min("ts").alias("open_utc")).where(F.weekday("day") < 5)
    out = rows.join(held, "day", "left")
    return out.groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("open_utc").isNull()).alias("rejected"))


FLT_01_SQL = f"""WITH r AS (SELECT event_id, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS day FROM events), h AS (SELECT CAST(ts AS DATE) AS day FROM events GROUP BY 1 HAVING isodow(CAST(ts AS DATE)) <= 5)
SELECT r.day, count(*) AS n, count(*) FILTER (h.day IS NULL) AS rejected FROM r LEFT JOIN h ON h.day = r.day GROUP BY r.day"""


def join_05_staleness(spark, sf_dir):
    """Weekdays since the latest order of a priority at each ship date; -1 before the first."""
    days = item_bars(spark, sf_dir).select(F.to_date("ts").alias("ts")).distinct()
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), F.to_date("o_orderdate").alias("ts")).distinct()
    left = days.crossJoin(F.broadcast(keys.select("k").distinct()))
    joined = asof(left, keys.withColumn("last", F.col("ts")), "last", "k")
    return joined.select("k", "ts", F.when(F.col("last").isNull(), -1).otherwise(calendar.weekdays_between(F.col("last"), F.col("ts"))).cast("long").alias("stale"))


JOIN_05_SQL = f"""WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS ts FROM lineitem), o AS (SELECT DISTINCT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS last FROM orders), l AS (SELECT k, ts FROM d, (SELECT DISTINCT k FROM o)),
j AS (SELECT l.k, l.ts, o.last FROM l ASOF LEFT JOIN o ON l.k = o.k AND l.ts >= o.last)
SELECT k, ts, CAST(CASE WHEN last IS NULL THEN -1 ELSE date_diff('day', DATE '1900-01-01', ts) // 7 * 5 + least(date_diff('day', DATE '1900-01-01', ts) % 7 + 1, 5) - date_diff('day', DATE '1900-01-01', last) // 7 * 5 - least(date_diff('day', DATE '1900-01-01', last) % 7 + 1, 5) END AS BIGINT) AS stale FROM j"""


def join_09_valuation(spark, sf_dir):
    """Holdings of each flag cumulated over days and valued at the last known price on the calendar of all."""
    bars = item_bars(spark, sf_dir)
    grid = bars.select("ts").distinct().crossJoin(F.broadcast(bars.select("symbol").distinct()))
    wide = grid.join(bars.select("symbol", "ts", "close", "volume"), ["symbol", "ts"], "left")
    held, price = F.coalesce(F.sum("volume").over(running()), F.lit(0.0)), F.last("close", ignorenulls=True).over(running())
    return rounded(wide.select("symbol", "ts", held.alias("held"), (held * price).alias("value")).groupBy("ts").agg(F.sum("held").alias("held"), F.ln(F.sum("value")).alias("value")))


JOIN_09_SQL = f"""WITH {sql.BARS}, g AS (SELECT symbol, ts FROM (SELECT DISTINCT ts FROM bars), (SELECT DISTINCT symbol FROM bars)), w AS (SELECT g.symbol, g.ts, close, volume FROM g LEFT JOIN bars ON bars.symbol = g.symbol AND bars.ts = g.ts),
v AS (SELECT ts, coalesce(sum(volume) OVER ({W} ROWS UNBOUNDED PRECEDING), 0.0) AS held, last_value(close IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS p FROM w) SELECT ts, {sql.settled('sum(held)', 'held')}, {sql.settled('ln(sum(held * p))', 'value')} FROM v GROUP BY ts"""


def join_20_explained(spark, sf_dir):
    """Lines left-joined with the order decided on the same day, if any."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("d"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("d"), "o_orderstatus").dropDuplicates(["l_orderkey", "d"])
    return l.join(o, ["l_orderkey", "d"], "left").groupBy(F.coalesce("o_orderstatus", F.lit("none")).alias("decision")).agg(F.count("*").alias("n"))


JOIN_20_SQL = "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, any_value(o_orderstatus) AS s FROM orders GROUP BY 1, 2) SELECT coalesce(s, 'none') AS decision, count(*) AS n FROM lineitem LEFT JOIN o ON o_orderkey = l_orderkey AND d = CAST(l_shipdate AS DATE) GROUP BY 1"


def agg_35_calibration(spark, sf_dir):
    """Mean price share and observed rate of finished orders by quintile of the price."""
    o = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 600_000).alias("p"), (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    edges = o.agg(F.percentile("p", F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)])).alias("e"))
    b = o.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("e", lambda e: e < F.col("p"))).cast("long"))
    return rounded(b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("y").alias("observed")))


AGG_35_SQL = f"""WITH o AS (SELECT o_totalprice / 600000 AS p, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders), e AS (SELECT quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) AS e FROM o)
SELECT CAST(len(list_filter(e, lambda x: x < p)) AS BIGINT) AS bin, count(*) AS n, {sql.settled('avg(p)', 'predicted')}, {sql.settled('avg(y)', 'observed')} FROM o, e GROUP BY 1"""


def agg_36_training_fit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
    return rounded(o.groupBy("o_orderpriority").agg(F.median("o_totalprice").alias("middle"), F.avg("o_totalprice").alias("mean"), F.when(F.stddev_pop("o_totalprice") == 0, 1.0).otherwise(F.stddev_pop("o_totalprice")).alias("scale")), 4)


AGG_36_SQL = f"SELECT o_orderpriority, {sql.settled('median(o_totalprice)', 'middle', 4)}, {sql.settled('avg(o_totalprice)', 'mean', 4)}, {sql.settled('CASE WHEN stddev_pop(o_totalprice) = 0 THEN 1 ELSE stddev_pop(o_totalprice) END', 'scale', 4)} FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1"


def agg_42_overview(spark, sf_dir):
    b = item_bars(spark, sf_dir).withColumn("previous", lagged("close"))
    return rounded(b.groupBy("symbol").agg(F.max_by(F.struct("ts", "close", "previous"), "ts").alias("r")).select("symbol", "r.ts", "r.close", "r.previous", (F.col("r.close") / F.col("r.previous") - 1).alias("change")))


AGG_42_SQL = f"WITH {sql.BARS}, p AS (SELECT *, lag(close) OVER ({W}) AS previous FROM bars) SELECT symbol, ts, {sql.all_settled('close previous')}, {sql.settled('close / previous - 1', 'change')} FROM p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"


def agg_45_smoothed_grid(spark, sf_dir):
    """Scores of a grid of sizes smoothed with the mean of the cells one step away."""
    g = table(spark, sf_dir, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("score"))
    n = g.select((F.col("p_size") + 1).alias("p_size"), F.col("score").alias("s")).union(g.select((F.col("p_size") - 1).alias("p_size"), F.col("score").alias("s"))).groupBy("p_size").agg(F.avg("s").alias("near"))
    return rounded(g.join(n, "p_size").select("p_size", (0.5 * F.col("score") + 0.5 * F.col("near")).alias("smoothed")))


AGG_45_SQL = f"WITH g AS (SELECT p_size, avg(p_retailprice) AS score FROM part GROUP BY 1) SELECT a.p_size, {sql.settled('0.5 * any_value(a.score) + 0.5 * avg(b.score)', 'smoothed')} FROM g a JOIN g b ON abs(a.p_size - b.p_size) = 1 GROUP BY a.p_size"


def win_23_stale_volatility(spark, sf_dir):
    """Volatility of 60 sessions, and whether a run of more than 5 returns of zero lies inside them. Closes go by thousands, so
    that some stand still."""
    b = item_bars(spark, sf_dir).withColumn("close", F.round(F.col("close") / 1000) + 1)
    b = b.withColumn("r", F.ln(F.col("close") / lagged("close")))
    runs = with_runs(b.withColumn("still", F.coalesce(F.col("r") == 0, F.lit(False))), "still").withColumn("streak", F.when(F.col("still"), F.col("run_age")).otherwise(0))
    return rounded(runs.select("symbol", "ts", (full(F.stddev_samp("r"), F.col("r"), trailing(60), 60) * 252**0.5).alias("vol"), (F.max("streak").over(trailing(60)) > 5).alias("stale")))


WIN_23_SQL = f"""WITH {sql.BARS}, p AS (SELECT symbol, ts, round(close / 1000) + 1 AS close FROM bars), a AS (SELECT *, ln(close / lag(close) OVER ({W})) AS r FROM p),
f AS (SELECT *, coalesce(r = 0, false) AS still FROM a), i AS (SELECT *, row_number() OVER ({W}) - row_number() OVER (PARTITION BY symbol, still ORDER BY ts) AS g FROM f),
s AS (SELECT *, CASE WHEN still THEN row_number() OVER (PARTITION BY symbol, still, g ORDER BY ts) ELSE 0 END AS streak FROM i) SELECT symbol, ts, {sql.settled(sql.full('stddev_samp(r)', 'r', 60) + ' * sqrt(252.0)', 'vol')}, max(streak) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) > 5 AS stale FROM s"""


def topk_06_coordinator(spark, sf_dir):
    """Per day (cycle), exits (purchases) first, users with several proposals (crowded) last, then by value; five are taken."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    crowded = F.count("*").over(Window.partitionBy("day", "user_id")) > 1
    w = Window.partitionBy("day").orderBy(F.col("event_type") != "purchase", "crowded", F.desc("value"), "event_id")
    return e.withColumn("crowded", crowded).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("day", "place", "event_id", "crowded")


TOPK_06_SQL = """WITH e AS (SELECT *, CAST(ts AS DATE) AS day, count(*) OVER (PARTITION BY CAST(ts AS DATE), user_id) > 1 AS crowded FROM events)
SELECT day, row_number() OVER (PARTITION BY day ORDER BY event_type <> 'purchase', crowded, value DESC, event_id) AS place, event_id, crowded FROM e QUALIFY place <= 5"""


def topk_12_catch_up(spark, sf_dir):
    """Pending sessions after a day, the first ten."""
    return sessions(item_bars(spark, sf_dir)).where(F.col("ts") > F.lit("1996-02-01").cast("timestamp_ntz")).orderBy("ts").limit(10).select("ts", "next_ts")


TOPK_12_SQL = f"WITH {sql.BARS} SELECT ts, lead(ts) OVER (ORDER BY ts) AS next_ts FROM (SELECT DISTINCT ts FROM bars) QUALIFY row_number() OVER (PARTITION BY ts > TIMESTAMP '1996-02-01' ORDER BY ts) <= 10 AND ts > TIMESTAMP '1996-02-01'"


def set_05_splice(spark, sf_dir):
    """Closes of A before 1995 and of R, less a tenth, from then on."""
    b, at = item_bars(spark, sf_dir), F.lit("1995-01-01").cast("timestamp_ntz")
    return rounded(b.where((F.col("symbol") == "A") & (F.col("ts") < at)).select("ts", "close").unionByName(b.where((F.col("symbol") == "R") & (F.col("ts") >= at)).select("ts", (F.col("close") * 0.9).alias("close"))))


SET_05_SQL = f"WITH {sql.BARS} SELECT ts, {sql.settled('close', 'close')} FROM bars WHERE symbol = 'A' AND ts < TIMESTAMP '1995-01-01' UNION ALL SELECT ts, {sql.settled('close * 0.9', 'close')} FROM bars WHERE symbol = 'R' AND ts >= TIMESTAMP '1995-01-01'"


def fn_21_levels(spark, sf_dir):
    """Total-return levels after a yearly charge, as logarithms, against a reference day."""
    b = item_bars(spark, sf_dir).withColumn("log", F.ln(F.col("adj_close") / lagged("adj_close")) + F.ln(F.lit(1 - 0.002 / 252)))
    level = b.withColumn("level", F.sum("log").over(running()))
    reference = level.where(F.col("ts") <= F.lit("1996-01-01").cast("timestamp_ntz")).groupBy("symbol").agg(F.max_by("level", "ts").alias("at"))
    return rounded(level.join(F.broadcast(reference), "symbol").select("symbol", "ts", (F.col("level") - F.col("at")).alias("level")))


FN_21_SQL = f"WITH {sql.BARS}, a AS (SELECT symbol, ts, ln(adj_close / lag(adj_close) OVER ({W})) + ln(1 - 0.002 / 252) AS l FROM bars), s AS (SELECT symbol, ts, sum(l) OVER ({W} ROWS UNBOUNDED PRECEDING) AS level FROM a), r AS (SELECT symbol, arg_max(level, ts) AS z FROM s WHERE ts <= TIMESTAMP '1996-01-01' GROUP BY symbol) SELECT s.symbol, ts, {sql.settled('level - z', 'level')} FROM s JOIN r ON r.symbol = s.symbol"


def fn_31_hours(spark, sf_dir):
    h = F.hour("ts") + 1
    return rounded(table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg(F.sin(2 * F.pi() * h / 24)).alias("hour_sin"), F.avg(F.cos(2 * F.pi() * h / 24)).alias("hour_cos")))


FN_31_SQL = f"SELECT event_type, {sql.settled('avg(sin(2 * pi() * (hour(ts) + 1) / 24))', 'hour_sin')}, {sql.settled('avg(cos(2 * pi() * (hour(ts) + 1) / 24))', 'hour_cos')} FROM events GROUP BY 1"


def ml_20_balanced_weights(spark, sf_dir):
    """Equal mass for large orders and the rest of each priority, summing to the number of rows."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), (F.col("o_totalprice") > 300_000).alias("special"))
    g = o.groupBy("k", "special").agg(F.count("*").alias("n"))
    return rounded(g.withColumn("weight", F.sum("n").over(Window.partitionBy("k")) / F.count("*").over(Window.partitionBy("k")) / F.col("n")))


ML_20_SQL = f"WITH g AS (SELECT o_orderpriority AS k, o_totalprice > 300000 AS special, count(*) AS n FROM orders GROUP BY 1, 2) SELECT k, special, n, {sql.settled('sum(n) OVER (PARTITION BY k) / count(*) OVER (PARTITION BY k) / n', 'weight')} FROM g"


def ml_21_magnitude_weights(spark, sf_dir):
    b = item_bars(spark, sf_dir).withColumn("m", F.least(F.greatest(F.abs(F.ln(F.lead("close").over(by()) / F.col("close"))), F.lit(0.25)), F.lit(2.0)))
    return rounded(b.select("symbol", "ts", (F.col("m") / F.avg("m").over(Window.partitionBy("symbol"))).alias("weight")))


ML_21_SQL = f"WITH {sql.BARS}, m AS (SELECT symbol, ts, ln(lead(close) OVER ({W}) / close) AS l FROM bars), c AS (SELECT symbol, ts, CASE WHEN l IS NULL THEN 0.25 ELSE least(greatest(abs(l), 0.25), 2.0) END AS m FROM m) SELECT symbol, ts, {sql.settled('m / avg(m) OVER (PARTITION BY symbol)', 'weight')} FROM c"


def stat_14_gate(spark, sf_dir):
    """Gate of each priority's trades: enough, positive years, profit factor, mean, and the mean under stress, where each trade
    pays a twentieth of its risk more."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), F.year("o_orderdate").alias("y"), (F.col("o_totalprice") / 150_000 - 1).alias("r"))
    years = t.groupBy("k", "y").agg(F.sum("r").alias("r")).groupBy("k").agg(F.count_if(F.col("r") > 0).alias("good_years"), F.count("*").alias("years"))
    g = t.groupBy("k").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.avg(F.col("r") - 0.05).alias("stressed"), F.try_divide(F.sum(F.greatest("r", F.lit(0.0))), F.sum(F.greatest(-F.col("r"), F.lit(0.0)))).alias("pf")).join(years, "k")
    failed = F.array_compact(F.array(F.when(F.col("n") < 100, "few"), F.when(F.col("good_years") < F.col("years"), "years"), F.when(F.col("pf") < 1.05, "factor"), F.when(F.col("mean") <= 0, "mean"), F.when(F.col("stressed") <= 0, "stress")))
    return rounded(g.select("k", "n", "good_years", "mean", "stressed", "pf", F.array_join(failed, "+").alias("failed"), (F.size(failed) == 0).alias("passed")))


STAT_14_SQL = f"""WITH t AS (SELECT o_orderpriority AS k, year(o_orderdate) AS y, o_totalprice / 150000 - 1 AS r FROM orders), y AS (SELECT k, count(*) FILTER (r > 0) AS good_years, count(*) AS years FROM (SELECT k, y, sum(r) AS r FROM t GROUP BY 1, 2) GROUP BY k),
g AS (SELECT t.k, count(*) AS n, avg(r) AS mean, avg(r - 0.05) AS stressed, sum(greatest(r, 0)) / nullif(sum(greatest(-r, 0)), 0) AS pf, any_value(good_years) AS good_years, any_value(years) AS years FROM t JOIN y ON y.k = t.k GROUP BY t.k),
f AS (SELECT *, concat_ws('+', CASE WHEN n < 100 THEN 'few' END, CASE WHEN good_years < years THEN 'years' END, CASE WHEN pf < 1.05 THEN 'factor' END, CASE WHEN mean <= 0 THEN 'mean' END, CASE WHEN stressed <= 0 THEN 'stress' END) AS failed FROM g) SELECT k, n, good_years, {sql.all_settled('mean stressed pf')}, failed, failed = '' AS passed FROM f"""


def stm_10_ledger_alerts(spark, sf_dir):
    """Changes of an account's state over its records: customers' order statuses in order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").alias("ts"), "o_orderkey", "o_orderstatus")
    before = F.lag("o_orderstatus").over(Window.partitionBy("symbol").orderBy("ts", "o_orderkey"))
    return o.withColumn("before", before).where("before <> o_orderstatus").groupBy("before", F.col("o_orderstatus").alias("after")).agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("first_ts"))


STM_10_SQL = "WITH o AS (SELECT o_orderdate AS ts, o_orderstatus AS after, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) SELECT before, after, count(*) AS n, min(ts) AS first_ts FROM o WHERE before <> after GROUP BY 1, 2"


def stm_15_delivery(spark, sf_dir):
    """Delivery attempts due after 0, 60 and 360 seconds of each purchase, by the end of its day."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    tries = e.select("event_id", "ts", F.posexplode(F.array(F.lit(0), F.lit(60), F.lit(360)))).withColumn("due", F.timestamp_micros(F.unix_micros("ts") + F.col("col").cast("long") * 1_000_000))
    return tries.where(F.to_date("due") == F.to_date("ts")).groupBy((F.col("pos") + 1).cast("long").alias("attempt")).agg(F.count("*").alias("n"))


STM_15_SQL = "SELECT CAST(k AS BIGINT) AS attempt, count(*) AS n FROM events, (VALUES (1, 0), (2, 60), (3, 360)) AS d(k, s) WHERE event_type = 'purchase' AND CAST(ts + to_seconds(s) AS DATE) = CAST(ts AS DATE) GROUP BY 1"


def view_09_last_records(spark, sf_dir):
    """Records of the last three event days, newest first within type."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    w = Window.partitionBy("event_type").orderBy(F.desc("day"))
    return e.withColumn("d", F.dense_rank().over(w)).where("d <= 3").select("event_type", "day", "event_id")


VIEW_09_SQL = "SELECT event_type, CAST(ts AS DATE) AS day, event_id FROM events QUALIFY dense_rank() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE) DESC) <= 3"


_NAMES = [k for k in dict(globals()) if k.split("_")[0] in ("flt", "join", "agg", "win", "topk", "set", "fn", "reg", "str", "ml", "stat", "stm", "view") and callable(globals()[k]) and f"{'_'.join(k.split('_')[:2]).upper()}_SQL" in globals()]
QUERIES = {k: globals()[k] for k in _NAMES}
SQL = {k: globals()[f"{'_'.join(k.split('_')[:2]).upper()}_SQL"] for k in _NAMES}
