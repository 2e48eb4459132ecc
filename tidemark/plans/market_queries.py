"""Queries of joins, set operations, orderings, scalar functions, calendars and quote streams over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.functions.semantics import asof, by, full, lagged, prior, ratio, rounded, running, trailing, with_ranks, with_runs
from tidemark.plans import sql
from tidemark.sources.bars import event_bars, item_bars, quotes, sessions, table

# joins


def join_01_next_session(spark, sf_dir):
    """Each bar's next session by the calendar of all instruments, and whether the instrument has a bar there."""
    bars = item_bars(spark, sf_dir).select("symbol", "ts")
    joined = bars.join(sessions(bars), "ts").withColumn("own_next", F.lead("ts").over(by()))
    return joined.select("symbol", "ts", F.col("next_ts").alias("effective_at"), F.coalesce(F.col("own_next") == F.col("next_ts"), F.lit(False)).alias("has_bar"))


JOIN_01_SQL = f"""WITH {sql.BARS}, cal AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS n FROM (SELECT DISTINCT ts FROM bars))
SELECT symbol, bars.ts, cal.n AS effective_at, coalesce(lead(bars.ts) OVER (PARTITION BY symbol ORDER BY bars.ts) = cal.n, false) AS has_bar FROM bars JOIN cal ON cal.ts = bars.ts"""


def join_04_asof_rate(spark, sf_dir):
    """Each four-hour bar with the latest click quote at or before it."""
    rates = quotes(spark, sf_dir).where("symbol = 'click'").withColumn("rate", F.col("mid")).select(F.lit(1).alias("k"), "ts", "rate")
    bars = event_bars(spark, sf_dir, 4).select(F.lit(1).alias("k"), "symbol", "ts", "close")
    per_symbol = rates.join(F.broadcast(bars.select("symbol").distinct())).select("symbol", "ts", "rate")
    return rounded(asof(bars.drop("k"), per_symbol, "rate", "symbol"))


JOIN_04_SQL = f"""WITH {sql.QUOTES}, {sql.event_bars(4)}, r AS (SELECT ts, mid AS rate FROM quotes WHERE symbol = 'click')
SELECT symbol, ebars.ts, {sql.settled('close', 'close')}, {sql.settled('rate', 'rate')} FROM ebars ASOF LEFT JOIN r ON ebars.ts >= r.ts"""


def join_08_as_of(spark, sf_dir):
    """State of each instrument at one moment: its last row up to then."""
    seen = item_bars(spark, sf_dir).where(F.col("ts") <= F.lit("1996-06-15").cast("timestamp_ntz"))
    return rounded(seen.groupBy("symbol").agg(F.max_by(F.struct("ts", "close", "volume"), "ts").alias("r")).select("symbol", "r.*"))


JOIN_08_SQL = f"WITH {sql.BARS} SELECT symbol, max(ts) AS ts, {sql.settled('arg_max(close, ts)', 'close')}, {sql.settled('arg_max(volume, ts)', 'volume')} FROM bars WHERE ts <= TIMESTAMP '1996-06-15' GROUP BY symbol"


def join_10_previous_bucket(spark, sf_dir):
    """Hourly bars with the four-hour bucket before theirs, if that has all of its hours."""
    hours = event_bars(spark, sf_dir, 1)
    from tidemark.sources.bars import bucket_start

    parts = hours.withColumn("bucket", bucket_start(F.col("ts"), 4 * 3600))
    whole = parts.groupBy("symbol", "bucket").agg(F.max("high").alias("h4_high"), F.min("low").alias("h4_low"), F.count("*").alias("n")).where("n = 4")
    before = whole.select("symbol", (F.col("bucket") + F.expr("interval 4 hours")).alias("bucket"), "h4_high", "h4_low")
    return rounded(parts.join(before, ["symbol", "bucket"]).select("symbol", "ts", "close", "h4_high", "h4_low", ratio(F.col("close") - F.col("h4_low"), F.col("h4_high") - F.col("h4_low")).alias("position")))


JOIN_10_SQL = f"""WITH {sql.event_bars(1, "hbars")}, p AS (SELECT *, epoch_ms(CAST(floor(epoch(ts) / 14400) * 14400 AS BIGINT) * 1000) AS bucket FROM hbars),
w AS (SELECT symbol, bucket, max(high) AS h4_high, min(low) AS h4_low FROM p GROUP BY symbol, bucket HAVING count(*) = 4)
SELECT p.symbol, p.ts, {sql.all_settled('close h4_high h4_low')}, {sql.settled(sql.ratio('close - h4_low', 'h4_high - h4_low'), 'position')} FROM p JOIN w ON w.symbol = p.symbol AND w.bucket = p.bucket - INTERVAL 4 HOUR"""


def join_13_concurrency(spark, sf_dir):
    """How many label intervals of five days overlap at each order day, by a sweep of starts and ends; with the mean inverse."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("d")).distinct()
    starts = days.select("symbol", F.col("d").alias("at"), F.lit(1).alias("step"))
    ends = days.select("symbol", F.date_add("d", 5).alias("at"), F.lit(-1).alias("step"))
    steps = starts.union(ends).groupBy("symbol", "at").agg(F.sum("step").alias("step"), F.count_if(F.col("step") == 1).alias("starts"))
    swept = steps.withColumn("open", F.sum("step").over(running(ts="at")))
    return rounded(swept.where("starts > 0").groupBy("symbol").agg(F.count("*").alias("days"), F.max("open").alias("most"), F.avg(1 / F.col("open")).alias("uniqueness")))


JOIN_13_SQL = f"""WITH d AS (SELECT DISTINCT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS d FROM orders), e AS (SELECT symbol, d AS at_day, 1 AS step FROM d UNION ALL SELECT symbol, d + 5, -1 FROM d),
s AS (SELECT symbol, at_day, sum(step) AS step, count(*) FILTER (step = 1) AS starts FROM e GROUP BY 1, 2), o AS (SELECT *, sum(step) OVER (PARTITION BY symbol ORDER BY at_day ROWS UNBOUNDED PRECEDING) AS open FROM s)
SELECT symbol, count(*) AS days, CAST(max(open) AS BIGINT) AS most, {sql.settled('avg(1.0 / open)', 'uniqueness')} FROM o WHERE starts > 0 GROUP BY symbol"""


def join_17_unseen(spark, sf_dir):
    """Orders of customers that have none in the first half of the days: anti join on the customer."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    early = o.where(F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp")).select("o_custkey").distinct()
    return o.join(early, "o_custkey", "left_anti").dropDuplicates(["o_orderkey"]).groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


JOIN_17_SQL = "SELECT o_custkey, count(DISTINCT o_orderkey) AS n, min(o_orderkey) AS first_order FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders e WHERE e.o_custkey = o.o_custkey AND e.o_orderdate < TIMESTAMP '1995-06-01') GROUP BY o_custkey"


def join_23_grid(spark, sf_dir):
    """Stops and goals from the sizes of parts, in tenths, paired where the goal is at least 1.2 stops away; two short lists."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").alias("size")).distinct()
    stops = sizes.where("size % 5 = 0 and size <= 25").select((F.col("size") / 10).alias("stop"))
    goals = sizes.where("size % 10 = 0").agg(F.collect_list(F.col("size") / 10).alias("__goals"))
    grid = stops.join(F.broadcast(goals)).withColumn("goal", F.explode("__goals")).drop("__goals")
    return rounded(grid.withColumn("reward", F.try_divide("goal", "stop")).where("reward >= 1.2"))


JOIN_23_SQL = f"WITH s AS (SELECT DISTINCT p_size FROM part) SELECT a.p_size / 10 AS stop, b.p_size / 10 AS goal, {sql.settled('b.p_size / a.p_size', 'reward')} FROM s a JOIN s b ON b.p_size / a.p_size >= 1.2 WHERE a.p_size % 5 = 0 AND a.p_size <= 25 AND b.p_size % 10 = 0"


def join_28_triangulation(spark, sf_dir):
    """Rates between event types over a common one: direct, inverse, or crossed."""
    last = quotes(spark, sf_dir).groupBy("symbol").agg(F.max_by("mid", F.struct("ts", "event_id")).alias("rate")).where("symbol <> 'click'")
    a, b = last.alias("a"), last.alias("b")
    crossed = a.join(b, F.col("a.symbol") != F.col("b.symbol")).select(F.col("a.symbol").alias("base"), F.col("b.symbol").alias("quote"), F.try_divide(F.col("a.rate"), F.col("b.rate")).alias("rate"))
    direct = last.select(F.col("symbol").alias("base"), F.lit("click").alias("quote"), "rate")
    inverse = last.select(F.lit("click").alias("base"), F.col("symbol").alias("quote"), F.try_divide(F.lit(1.0), F.col("rate")).alias("rate"))
    return rounded(direct.unionByName(inverse).unionByName(crossed))


JOIN_28_SQL = f"""WITH {sql.QUOTES}, l AS (SELECT symbol, arg_max(mid, row(ts, event_id)) AS rate FROM quotes WHERE symbol <> 'click' GROUP BY symbol),
x AS (SELECT symbol AS base, 'click' AS quote, rate FROM l UNION ALL SELECT 'click', symbol, 1 / nullif(rate, 0) FROM l UNION ALL SELECT a.symbol, b.symbol, a.rate / nullif(b.rate, 0) FROM l a JOIN l b ON a.symbol <> b.symbol) SELECT base, quote, {sql.settled('rate', 'rate')} FROM x"""

# aggregates


def agg_37_resample(spark, sf_dir):
    return rounded(event_bars(spark, sf_dir, 4))


AGG_37_SQL = f"WITH {sql.event_bars(4)} SELECT symbol, ts, {sql.all_settled('open high low close volume')} FROM ebars"


def agg_28_price_audit(spark, sf_dir):
    """Counts, the longest constant run of volume, extreme moves and calendar gaps of each instrument."""
    bars = item_bars(spark, sf_dir)
    cal = sessions(bars)
    runs = with_runs(bars, "volume").groupBy("symbol").agg(F.max("run_age").alias("longest_constant"))
    moved = bars.withColumn("move", F.ln(F.col("close") / lagged("close")))
    out = moved.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if(F.abs("move") > 1).alias("extreme"), F.max(F.abs(F.col("move"))).alias("largest"))
    return rounded(out.join(runs, "symbol").crossJoin(F.broadcast(cal.agg(F.count("*").alias("calendar")))).withColumn("absent", F.col("calendar") - F.col("bars")))


AGG_28_SQL = f"""WITH {sql.BARS}, m AS (SELECT *, ln(close / lag(close) OVER ({sql.W})) AS move, row_number() OVER ({sql.W}) - row_number() OVER (PARTITION BY symbol, volume ORDER BY ts) AS g FROM bars),
r AS (SELECT symbol, max(n) AS longest_constant FROM (SELECT symbol, volume, g, count(*) AS n FROM m GROUP BY ALL) GROUP BY symbol), c AS (SELECT count(DISTINCT ts) AS calendar FROM bars)
SELECT m.symbol, count(*) AS bars, count(*) FILTER (abs(move) > 1) AS extreme, {sql.settled('max(abs(move))', 'largest')}, any_value(longest_constant) AS longest_constant, any_value(calendar) AS calendar, any_value(calendar) - count(*) AS absent FROM m JOIN r ON r.symbol = m.symbol, c GROUP BY m.symbol"""


def agg_32_partition(spark, sf_dir):
    """Development, validation and test by month ends at or before 60 and 80 percent of sessions."""
    cal = sessions(item_bars(spark, sf_dir)).select("ts")
    w = Window.orderBy("ts")
    ranked = cal.withColumns({"share": F.row_number().over(w) / F.count("*").over(Window.partitionBy(F.lit(1))), "month_end": F.coalesce(F.month(F.lead("ts").over(w)) != F.month("ts"), F.lit(True))})
    ends = ranked.agg(F.max(F.when(F.col("month_end") & (F.col("share") <= 0.6), F.col("ts"))).alias("a"), F.max(F.when(F.col("month_end") & (F.col("share") <= 0.8), F.col("ts"))).alias("b"))
    part = F.when(F.col("ts") <= F.col("a"), "development").when(F.col("ts") <= F.col("b"), "validation").otherwise("test")
    return ranked.crossJoin(F.broadcast(ends)).groupBy(part.alias("part")).agg(F.count("*").alias("sessions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


AGG_32_SQL = f"""WITH {sql.BARS}, c AS (SELECT DISTINCT ts FROM bars), r AS (SELECT ts, row_number() OVER (ORDER BY ts) / (count(*) OVER ())::DOUBLE AS share, coalesce(month(lead(ts) OVER (ORDER BY ts)) <> month(ts), true) AS me FROM c),
e AS (SELECT max(ts) FILTER (me AND share <= 0.6) AS a, max(ts) FILTER (me AND share <= 0.8) AS b FROM r)
SELECT CASE WHEN ts <= a THEN 'development' WHEN ts <= b THEN 'validation' ELSE 'test' END AS part, count(*) AS sessions, min(ts) AS first_ts, max(ts) AS last_ts FROM r, e GROUP BY 1"""


def agg_33_classification(spark, sf_dir):
    """Accuracy, balance, precision, recall and AUC (by average ranks) of totalprice as a score for the status."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / 500_000).alias("p"), F.col("o_orderpriority").alias("slice"))
    rank = F.rank().over(Window.partitionBy("slice").orderBy("p")) + (F.count("*").over(Window.partitionBy("slice", "p")) - 1) / 2
    hit = (F.col("p") > 0.5).cast("int")
    g = o.withColumn("r", rank).groupBy("slice").agg(
        F.count("*").alias("n"), F.sum("y").alias("positives"), F.avg((hit == F.col("y")).cast("double")).alias("accuracy"), F.sum(hit * F.col("y")).alias("tp"), F.sum(hit).alias("called"), F.sum(F.when(F.col("y") == 1, F.col("r"))).alias("rank_sum")
    )
    auc = F.try_divide(F.col("rank_sum") - F.col("positives") * (F.col("positives") + 1) / 2, F.col("positives") * (F.col("n") - F.col("positives")))
    return rounded(g.withColumns({"precision": F.try_divide(F.col("tp"), F.col("called")), "recall": F.try_divide(F.col("tp"), F.col("positives")), "auc": auc}).drop("rank_sum"))


AGG_33_SQL = f"""WITH o AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_totalprice / 500000 AS p, o_orderpriority AS slice FROM orders),
r AS (SELECT *, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS hit, rank() OVER (PARTITION BY slice ORDER BY p) + (count(*) OVER (PARTITION BY slice, p) - 1) / 2.0 AS r FROM o),
g AS (SELECT slice, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, avg(CASE WHEN hit = y THEN 1.0 ELSE 0.0 END) AS accuracy, CAST(sum(hit * y) AS BIGINT) AS tp, CAST(sum(hit) AS BIGINT) AS called, CAST(sum(r) FILTER (y = 1) AS DOUBLE) AS rs FROM r GROUP BY slice)
SELECT slice, n, positives, tp, called, {sql.settled('accuracy', 'accuracy')}, {sql.settled('tp / called', 'precision')}, {sql.settled('tp / positives', 'recall')}, {sql.settled('(rs - positives * (positives + 1) / 2) / (positives * (n - positives))', 'auc')} FROM g"""


#: Frozen rates of the quoted currencies to one euro (fixed values), and the currency in which an event type is quoted.
EURO = {"USD": 1.10, "JPY": 165.0, "CHF": 0.94, "CAD": 1.50, "GBP": 0.85}
QUOTED = {"click": "USD", "error": "JPY", "purchase": "CHF", "signup": "CAD", "view": "GBP"}


def agg_20_daily_cash(spark, sf_dir):
    """Cash realised by UTC day: each event is a close that earned its value less 50, converted to euros by its currency's frozen
    rate; a type without a currency has no rate and counts as unconverted."""
    rate = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(EURO[c])) for k, c in QUOTED.items()])
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), ((F.col("value") - 50) / rate).alias("cash"))
    return rounded(e.groupBy("day").agg(F.sum("cash").alias("cash"), F.count("*").alias("n"), F.count_if(F.col("cash").isNull()).alias("unconverted")))


AGG_20_SQL = f"""WITH r(event_type, rate) AS (VALUES ('click', 1.10::DOUBLE), ('error', 165.0), ('purchase', 0.94), ('signup', 1.50), ('view', 0.85))
SELECT CAST(ts AS DATE) AS day, {sql.settled('sum((value - 50) / rate)', 'cash')}, count(*) AS n, count(*) FILTER ((value - 50) / rate IS NULL) AS unconverted FROM events LEFT JOIN r USING (event_type) GROUP BY 1"""


def agg_18_r_multiples(spark, sf_dir):
    """Orders as trades with R-multiples: mean, win rate, profit factor, worst drawdown of realised closes."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), (F.col("o_totalprice") / 150_000 - 1).alias("r"))
    closes = t.groupBy("symbol", "ts").agg(F.sum("r").alias("r"))
    total = closes.withColumn("total", F.sum("r").over(running()))
    down = total.withColumn("down", F.greatest(F.max("total").over(running()), F.lit(0.0)) - F.col("total")).groupBy("symbol").agg(F.max("down").alias("max_drawdown"))
    g = t.groupBy("symbol").agg(F.count("*").alias("trades"), F.avg("r").alias("mean_r"), F.median("r").alias("median_r"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.try_divide(F.sum(F.greatest("r", F.lit(0.0))), F.sum(F.greatest(-F.col("r"), F.lit(0.0)))).alias("profit_factor"), (F.avg("r") / F.stddev_samp("r") * F.sqrt(F.count("*"))).alias("t_stat"))
    return rounded(g.join(down, "symbol"), 5)


AGG_18_SQL = f"""WITH t AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_totalprice / 150000 - 1 AS r FROM orders), c AS (SELECT symbol, ts, sum(r) AS r FROM t GROUP BY 1, 2), s AS (SELECT *, sum(r) OVER ({sql.W} ROWS UNBOUNDED PRECEDING) AS total FROM c),
d AS (SELECT symbol, max(down) AS md FROM (SELECT symbol, greatest(max(total) OVER ({sql.W} ROWS UNBOUNDED PRECEDING), 0) - total AS down FROM s) GROUP BY symbol)
SELECT t.symbol, count(*) AS trades, {sql.settled('avg(r)', 'mean_r', 5)}, {sql.settled('median(r)', 'median_r', 5)}, {sql.settled('avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END)', 'win_rate', 5)}, {sql.settled('sum(greatest(r, 0)) / sum(greatest(-r, 0))', 'profit_factor', 5)},
  {sql.settled('avg(r) / stddev_samp(r) * sqrt(count(*))', 't_stat', 5)}, {sql.settled('any_value(md)', 'max_drawdown', 5)} FROM t JOIN d ON d.symbol = t.symbol GROUP BY t.symbol"""

# windows


def win_02_prior_means(spark, sf_dir):
    b = item_bars(spark, sf_dir)
    return rounded(b.select("symbol", "ts", full(F.avg("volume"), F.col("volume"), prior(10), 10).alias("prior_mean"), ratio(F.abs(F.col("close") - lagged("close", 20)), F.lit(1.0)).alias("net_move")))


WIN_02_SQL = f"WITH {sql.BARS} SELECT symbol, ts, {sql.settled(sql.full('avg(volume)', 'volume', 10, 'prior'), 'prior_mean')}, {sql.settled(f'round(abs(close - lag(close, 20) OVER ({sql.W})), 10)', 'net_move')} FROM bars"


def win_18_efficiency(spark, sf_dir):
    """Net move over the path of 20 bars."""
    b = item_bars(spark, sf_dir).withColumn("step", F.abs(F.col("close") - lagged("close")))
    return rounded(b.select("symbol", "ts", F.try_divide(F.abs(F.col("close") - lagged("close", 20)), full(F.sum("step"), F.col("step"), trailing(20), 20)).alias("efficiency")))


WIN_18_SQL = f"WITH {sql.BARS}, s AS (SELECT *, abs(close - lag(close) OVER ({sql.W})) AS step FROM bars) SELECT symbol, ts, {sql.settled(f'abs(close - lag(close, 20) OVER ({sql.W})) / nullif({sql.full('sum(step)', 'step', 20)}, 0)', 'efficiency')} FROM s"


def win_19_percent_rank(spark, sf_dir):
    """Average-rank percentile of a close among its last 200, from 100 on."""
    b = with_ranks(item_bars(spark, sf_dir), "close", 199)
    n = F.col("__count") + 1
    return rounded(b.select("symbol", "ts", F.when(n >= 100, (F.col("__below") + 0.5 * (F.col("__equal") + 2)) / n).alias("rank")))


WIN_19_SQL = f"WITH {sql.BARS}, l AS (SELECT symbol, ts, close, list(close) OVER ({sql.W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS l FROM bars) SELECT symbol, ts, {sql.settled('CASE WHEN len(l) >= 100 THEN (len(list_filter(l, lambda x: x < close)) + 0.5 * (len(list_filter(l, lambda x: x = close)) + 1)) / len(l) END', 'rank')} FROM l"


def win_35_rolling_median(spark, sf_dir):
    b = item_bars(spark, sf_dir).withColumn("body", F.abs(F.col("close") - F.col("open")))
    return rounded(b.select("symbol", "ts", full(F.percentile("body", F.lit(0.5)), F.col("body"), prior(20), 20).alias("median_body")))


WIN_35_SQL = f"WITH {sql.BARS}, b AS (SELECT symbol, ts, abs(close - open) AS body FROM bars) SELECT symbol, ts, {sql.settled(sql.full('median(body)', 'body', 20, 'prior'), 'median_body')} FROM b"


def win_36_index_features(spark, sf_dir):
    b = event_bars(spark, sf_dir, 1)
    log = lambda k: F.ln(F.try_divide(F.col("close"), lagged("close", k)))
    b = b.withColumns({f"r{k}": log(k) for k in (1, 3, 12, 48)})
    return rounded(b.select("symbol", "ts", "r1", "r3", "r12", "r48", full(F.stddev_samp("r1"), F.col("r1"), trailing(48), 48).alias("vol48"), F.signum(F.lead("close", 96).over(by()) - F.col("close")).alias("label")))


WIN_36_SQL = f"WITH {sql.event_bars(1, 'hb')}, r AS (SELECT *, {', '.join(f'ln(close / nullif(lag(close, {k}) OVER ({sql.W}), 0)) AS r{k}' for k in (1, 3, 12, 48))}, CAST(sign(lead(close, 96) OVER ({sql.W}) - close) AS DOUBLE) AS label FROM hb) SELECT symbol, ts, {sql.all_settled('r1 r3 r12 r48')}, {sql.settled(sql.full('stddev_samp(r1)', 'r1', 48), 'vol48')}, {sql.settled('label', 'label')} FROM r"


def win_26_transitions(spark, sf_dir):
    b = item_bars(spark, sf_dir).withColumn("way", F.when(F.col("close") >= F.col("open"), "up").otherwise("down"))
    return with_runs(b, "way").select("symbol", "ts", "way", "run_id", "run_age")


WIN_26_SQL = f"""WITH {sql.BARS}, b AS (SELECT symbol, ts, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS way FROM bars), c AS (SELECT *, CASE WHEN way IS DISTINCT FROM lag(way) OVER ({sql.W}) THEN 1 ELSE 0 END AS n FROM b),
r AS (SELECT *, CAST(sum(n) OVER ({sql.W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM c) SELECT symbol, ts, way, run_id, row_number() OVER (PARTITION BY symbol, run_id ORDER BY ts) AS run_age FROM r"""


def win_38_target(spark, sf_dir):
    return item_bars(spark, sf_dir).select("symbol", "ts", (F.lead("close").over(by()) > F.col("close")).cast("int").alias("target"))


WIN_38_SQL = f"WITH {sql.BARS} SELECT symbol, ts, CAST(lead(close) OVER ({sql.W}) > close AS INTEGER) AS target FROM bars"

# order, sets


def topk_03_best(spark, sf_dir):
    """Share of the five largest orders in each priority's total."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return rounded(o.withColumn("i", F.row_number().over(w)).groupBy("o_orderpriority").agg(F.try_divide(F.sum(F.when(F.col("i") <= 5, F.col("o_totalprice"))), F.sum("o_totalprice")).alias("top5_share")))


TOPK_03_SQL = f"SELECT o_orderpriority, {sql.settled('sum(o_totalprice) FILTER (i <= 5) / sum(o_totalprice)', 'top5_share')} FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) GROUP BY 1"


def topk_08_worst(spark, sf_dir):
    b = item_bars(spark, sf_dir)
    return rounded(b.select("symbol", "ts", F.abs(F.col("close") - F.col("adj_close")).alias("gap")).orderBy(F.desc("gap"), "symbol", "ts").limit(5))


TOPK_08_SQL = f"WITH {sql.BARS} SELECT symbol, ts, {sql.settled('abs(close - adj_close)', 'gap')} FROM bars ORDER BY abs(close - adj_close) DESC, symbol, ts LIMIT 5"


def topk_09_session_before(spark, sf_dir):
    return sessions(item_bars(spark, sf_dir)).where(F.col("ts") <= F.lit("1997-03-03").cast("timestamp_ntz")).agg(F.max("ts").alias("session"), F.max("next_ts").alias("next_session"), F.count("*").alias("so_far"))


TOPK_09_SQL = f"WITH {sql.BARS}, c AS (SELECT DISTINCT ts FROM bars), n AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS n FROM c) SELECT max(ts) AS session, max(n) AS next_session, count(*) AS so_far FROM n WHERE ts <= TIMESTAMP '1997-03-03'"


def set_02_master(spark, sf_dir):
    """Distinct union of the sessions of lines and orders."""
    a, b = item_bars(spark, sf_dir).select("ts"), table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    return a.union(b).distinct()


SET_02_SQL = "SELECT l_shipdate AS ts FROM lineitem UNION SELECT o_orderdate FROM orders"


def set_04_differences(spark, sf_dir):
    """Sessions that only one of two instruments has."""
    b = item_bars(spark, sf_dir)
    a, r = b.where("symbol = 'A'").select("ts"), b.where("symbol = 'R'").select("ts")
    return a.exceptAll(r).withColumn("side", F.lit("extra")).union(r.exceptAll(a).withColumn("side", F.lit("missing")))


SET_04_SQL = f"WITH {sql.BARS}, a AS (SELECT ts FROM bars WHERE symbol = 'A'), r AS (SELECT ts FROM bars WHERE symbol = 'R') SELECT ts, 'extra' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM r) UNION ALL SELECT ts, 'missing' FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM a)"


def set_06_causes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "+").alias("causes"))


SET_06_SQL = "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '+' ORDER BY o_orderstatus) AS causes FROM orders GROUP BY 1"

# functions


def fn_05_trading_day(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(calendar.trading_day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"), F.count_if(calendar.market_open(F.col("ts"))).alias("open_n"))


NY = "timezone('America/New_York', timezone('UTC', ts))"
FN_05_SQL = f"""SELECT CAST({NY} + INTERVAL 7 HOUR AS DATE) AS day, count(*) AS n, count(*) FILTER (isodow({NY} + INTERVAL 7 HOUR) <= 5) AS open_n FROM events GROUP BY 1"""


def fn_07_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(calendar.active_sessions(F.col("ts")).alias("active")).agg(F.count("*").alias("n"))


def _local(zone, a, z):
    return f"hour(timezone('{zone}', timezone('UTC', ts))) BETWEEN {a} AND {z - 1}"


FN_07_SQL = f"""SELECT concat_ws('+', CASE WHEN {_local('Australia/Sydney', 7, 16)} THEN 'Sydney' END, CASE WHEN {_local('Asia/Tokyo', 9, 18)} THEN 'Tokyo' END, CASE WHEN {_local('Europe/London', 8, 17)} THEN 'London' END, CASE WHEN {_local('America/New_York', 8, 17)} THEN 'New York' END) AS active, count(*) AS n FROM events GROUP BY 1"""


def fn_10_weekdays(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    days = l.select(F.to_date("l_shipdate").alias("a")).distinct().withColumn("z", F.date_add("a", 9 + F.day("a")))
    return days.select("a", "z", calendar.weekdays_between(F.col("a"), F.col("z")).alias("n"))


FN_10_SQL = "WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS a FROM lineitem) SELECT a, a + CAST(9 + day(a) AS INTEGER) AS z, CAST((SELECT count(*) FROM unnest(generate_series(a + 1, a + CAST(9 + day(a) AS INTEGER), INTERVAL 1 DAY)) AS u(x) WHERE isodow(x) <= 5) AS BIGINT) AS n FROM d"


def fn_13_reasons(spark, sf_dir):
    b = item_bars(spark, sf_dir)
    return b.select("symbol", "ts", F.concat_ws(";", F.format_string("volume=%.2f", F.col("volume")), F.concat(F.lit("days="), F.dayofyear("ts").cast("string"))).alias("reason"), F.substring(F.sha2(F.concat_ws("|", "symbol", F.date_format("ts", "yyyy-MM-dd")), 256), 1, 16).alias("id"))


FN_13_SQL = f"WITH {sql.BARS} SELECT symbol, ts, printf('volume=%.2f', volume) || ';days=' || dayofyear(ts) AS reason, substr(sha256(symbol || '|' || strftime(ts, '%Y-%m-%d')), 1, 16) AS id FROM bars"


def fn_09_period_ends(spark, sf_dir):
    cal = sessions(item_bars(spark, sf_dir))
    return cal.select("ts", (F.trunc("next_ts", "month") > F.trunc("ts", "month")).alias("month_end"), (F.year("next_ts") > F.year("ts")).alias("year_end"))


FN_09_SQL = f"WITH {sql.BARS}, n AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS n FROM (SELECT DISTINCT ts FROM bars)) SELECT ts, date_trunc('month', n) > date_trunc('month', ts) AS month_end, year(n) > year(ts) AS year_end FROM n"


def fn_27_sizing(spark, sf_dir):
    """Vol-scaled target weights, whole units, commission with floor and cap, limit price on a tick."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    weight = F.least(F.lit(1.0), F.lit(0.1) / (F.col("p_size") / 100)) / 5
    units = F.floor(weight * 1_000_000 / F.col("p_retailprice")).cast("long")
    p = p.withColumns({"weight": weight, "units": units}).withColumn("notional", F.col("units") * F.col("p_retailprice"))
    return rounded(p.select("p_partkey", "weight", "units", F.least(F.greatest(F.col("notional") * 0.0005, F.lit(1.0)), F.lit(50.0)).alias("commission"), (F.floor((F.col("p_retailprice").cast("decimal(18,4)") * F.lit("1.005").cast("decimal(18,4)")) * 100) / 100).cast("decimal(18,2)").alias("limit_price")))


FN_27_SQL = f"""WITH w AS (SELECT p_partkey, p_retailprice, least(1.0, 0.1 / (p_size / 100.0::DOUBLE)) / 5 AS weight FROM part), u AS (SELECT *, CAST(floor(weight * 1000000 / p_retailprice) AS BIGINT) AS units FROM w)
SELECT p_partkey, {sql.settled('weight', 'weight')}, units, {sql.settled('least(greatest(units * p_retailprice * 0.0005, 1.0), 50.0)', 'commission')}, CAST(floor(CAST(p_retailprice AS DECIMAL(18,4)) * 1.005 * 100) / 100 AS DECIMAL(18,2)) AS limit_price FROM u"""


def fn_33_recency(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), F.to_date("o_orderdate").alias("d"))
    last = o.agg(F.max("d").alias("z"))
    aged = o.crossJoin(F.broadcast(last)).withColumn("w", F.pow(F.lit(2.0), -F.datediff("z", "d") / 180))
    return rounded(aged.groupBy("k").agg(F.sum("w").alias("weight"), F.avg("w").alias("mean")))


FN_33_SQL = f"WITH o AS (SELECT o_orderpriority AS k, pow(2.0, -date_diff('day', CAST(o_orderdate AS DATE), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders)) / 180.0) AS w FROM orders) SELECT k, {sql.settled('sum(w)', 'weight')}, {sql.settled('avg(w)', 'mean')} FROM o GROUP BY k"


def flt_22_spread(spark, sf_dir):
    """Quotes widened symmetrically to a floor of the spread for each symbol."""
    floors = spark.createDataFrame([("click", 0.05), ("purchase", 0.1)], "symbol string, floor double")
    q = quotes(spark, sf_dir).join(F.broadcast(floors), "symbol", "left")
    half = F.greatest(F.col("ask") - F.col("bid"), F.coalesce("floor", F.lit(0.0))) / 2
    return rounded(q.select("event_id", "symbol", ((F.col("ask") + F.col("bid")) / 2 - half).alias("bid"), ((F.col("ask") + F.col("bid")) / 2 + half).alias("ask")))


FLT_22_SQL = f"WITH {sql.QUOTES}, h AS (SELECT *, greatest(ask - bid, CASE symbol WHEN 'click' THEN 0.05 WHEN 'purchase' THEN 0.1 ELSE 0.0 END) / 2 AS half FROM quotes) SELECT event_id, symbol, {sql.settled('(ask + bid) / 2 - half', 'bid')}, {sql.settled('(ask + bid) / 2 + half', 'ask')} FROM h"


def flt_31_slices(spark, sf_dir):
    slices = spark.createDataFrame([("full", "1992-01-01", "1999-12-31"), ("early", "1992-01-01", "1995-12-31"), ("late", "1996-01-01", "1999-12-31")], "slice string, a string, z string")
    b = item_bars(spark, sf_dir)
    inside = F.col("ts").between(F.col("a").cast("timestamp_ntz"), F.col("z").cast("timestamp_ntz"))
    return b.join(F.broadcast(slices), inside).groupBy("slice", "symbol").agg(F.count("*").alias("sessions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


FLT_31_SQL = f"WITH {sql.BARS}, s(slice, a, z) AS (VALUES ('full', TIMESTAMP '1992-01-01', TIMESTAMP '1999-12-31'), ('early', TIMESTAMP '1992-01-01', TIMESTAMP '1995-12-31'), ('late', TIMESTAMP '1996-01-01', TIMESTAMP '1999-12-31')) SELECT slice, symbol, count(*) AS sessions, min(ts) AS first_ts, max(ts) AS last_ts FROM bars JOIN s ON ts BETWEEN a AND z GROUP BY 1, 2"


def stm_13_episodes(spark, sf_dir):
    """Rising edges of a condition: one alert when it begins, armed again when it clears; ids from the key."""
    b = item_bars(spark, sf_dir).withColumn("active", F.col("volume") < 100)
    begins = b.withColumn("before", F.coalesce(lagged("active"), F.lit(False))).where("active and not before")
    return begins.select("symbol", "ts", F.sha2(F.concat_ws("|", F.lit("low_volume"), "symbol", F.date_format("ts", "yyyy-MM-dd")), 256).alias("alert_id")).dropDuplicates(["alert_id"])


STM_13_SQL = f"WITH {sql.BARS}, a AS (SELECT *, volume < 100 AS active, coalesce(lag(volume < 100) OVER ({sql.W}), false) AS before FROM bars) SELECT symbol, ts, sha256('low_volume|' || symbol || '|' || strftime(ts, '%Y-%m-%d')) AS alert_id FROM a WHERE active AND NOT before"

_FUNCTIONS = [k for k in dict(globals()) if k[:4] in ("join", "agg_", "win_", "topk", "set_", "fn_0", "fn_1", "fn_2", "fn_3", "flt_", "stm_")]
QUERIES = {k: globals()[k] for k in _FUNCTIONS}
SQL = {k: globals()["_".join(k.split("_")[:2]).upper() + "_SQL"] for k in _FUNCTIONS}
