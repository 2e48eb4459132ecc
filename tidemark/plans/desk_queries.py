"""Queries of contracts, intraday features, semi joins with patterns, reconciliation and alert tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import by, lagged, rounded
from tidemark.operators import contracts
from tidemark.plans import sql
from tidemark.plans.candle_queries import OBSERVATIONS_CTE, observations
from tidemark.plans.price_queries import REG_06_SQL, reg_06_fx_regime
from tidemark.sources.bars import event_bars, item_bars, quotes, resample, table

W = sql.W
NOW = "2024-01-20 10:30:00"


def _grid(source: str, sides: tuple[str, ...] = ("",)) -> str:
    bad = " OR ".join(f"{s}{p} IS NULL OR isnan({s}{p}) OR isinf({s}{p}) OR {s}{p} <= 0" for s in sides for p in contracts.PRICES)
    odd = " OR ".join(f"{s}high < greatest({s}open, {s}low, {s}close) OR {s}low > least({s}open, {s}high, {s}close)" for s in sides)
    crossed = "count(*) FILTER (bid_close > ask_close)" if len(sides) == 2 else "CAST(0 AS BIGINT)"
    return f"""st AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER ({W})) AS step FROM {source}), ck AS (SELECT symbol, count(*) AS bars, count(*) FILTER (epoch_us(ts) % 3600000000 <> 0) AS off_grid, count(*) FILTER (step = 3600) / count(*) AS adjacent,
count(*) FILTER ({bad}) AS bad_price, count(*) FILTER ({odd}) AS inconsistent, {crossed} AS crossed FROM st GROUP BY symbol)
SELECT symbol, bars, off_grid, {sql.settled('adjacent', 'adjacent')}, bad_price, inconsistent, crossed, CASE WHEN off_grid > 0 THEN 'off_grid' WHEN adjacent < 0.8 THEN 'not_adjacent' WHEN bad_price > 0 THEN 'bad_price' WHEN inconsistent > 0 THEN 'inconsistent' WHEN crossed > 0 THEN 'crossed' ELSE '' END AS reason FROM ck"""


def flt_24_batch_check(spark, sf_dir):
    """Hourly bars held against the hourly grid."""
    return rounded(contracts.grid_check(event_bars(spark, sf_dir, 1), 60))


FLT_24_SQL = f"WITH {sql.event_bars(1, 'hb')}, {_grid('hb')}"


def flt_25_closed_check(spark, sf_dir):
    """The same of the bars that had ended by a time."""
    return rounded(contracts.grid_check(contracts.closed(event_bars(spark, sf_dir, 1), 60, NOW), 60))


FLT_25_SQL = f"WITH {sql.event_bars(1, 'hb')}, cl AS (SELECT * FROM hb WHERE ts + INTERVAL 60 MINUTE <= TIMESTAMP '{NOW}'), {_grid('cl')}"


def flt_26_watch_check(spark, sf_dir):
    """Bid and ask bars that had ended by a time, their closes not crossed."""
    q = quotes(spark, sf_dir)
    bid, ask = (resample(q.select("symbol", "ts", F.col(s).alias("price")), 3600).select("symbol", "ts", *[F.col(p).alias(f"{s}_{p}") for p in contracts.PRICES]) for s in ("bid", "ask"))
    return rounded(contracts.grid_check(contracts.closed(bid.join(ask, ["symbol", "ts"]), 60, NOW), 60, ("bid_", "ask_")))


FLT_26_SQL = f"""WITH {sql.QUOTES}, hq AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, {", ".join(f"arg_min({s}, q.ts) AS {s}_open, max({s}) AS {s}_high, min({s}) AS {s}_low, arg_max({s}, q.ts) AS {s}_close" for s in ("bid", "ask"))} FROM quotes q GROUP BY 1, 2),
cl AS (SELECT * FROM hq WHERE ts + INTERVAL 60 MINUTE <= TIMESTAMP '{NOW}'), {_grid('cl', ('bid_', 'ask_'))}"""


def flt_27_signal_contract(spark, sf_dir):
    """Signals of hourly bars: direction of the bar, its range as stop, twice the last change as target."""
    b = event_bars(spark, sf_dir, 1)
    s = b.select("symbol", F.signum(F.col("close") - F.col("open")).cast("int").alias("dir"), (F.col("high") - F.col("low")).alias("stop_dist"), (2 * (F.col("close") - lagged("close"))).alias("target_dist"), (F.col("close") / 50).alias("score"), (F.col("volume") - 1).alias("max_hold"))
    return contracts.signal_contract(s)


FLT_27_SQL = f"""WITH {sql.event_bars(1, 'hb')}, s AS (SELECT symbol, CAST(sign(close - open) AS INTEGER) AS dir, high - low AS stop, 2 * (close - lag(close) OVER ({W})) AS target, close / 50 AS score, volume - 1 AS hold FROM hb)
SELECT symbol, count(*) AS rows, count(*) FILTER (dir NOT IN (-1, 0, 1)) AS bad_dir, count(*) FILTER (dir <> 0 AND NOT coalesce(stop > 0, false)) AS bad_stop_dist, count(*) FILTER (dir <> 0 AND NOT coalesce(target > 0, false)) AS bad_target_dist,
count(*) FILTER (dir <> 0 AND NOT (score BETWEEN 0 AND 1)) AS bad_score, count(*) FILTER (dir <> 0 AND hold < 1) AS bad_max_hold FROM s GROUP BY symbol"""


def flt_17_engine_contract(spark, sf_dir):
    """Of the raw lines as bars of one price, repeated times included."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    raw = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), price.alias("open"), price.alias("high"), (price - F.col("l_tax") + 0.04).alias("low"), price.alias("close"))
    return contracts.engine_contract(raw)


FLT_17_SQL = """WITH r AS (SELECT l_returnflag AS symbol, l_shipdate AS ts, l_extendedprice / l_quantity AS p, l_extendedprice / l_quantity - l_tax + 0.04 AS low FROM lineitem)
SELECT symbol, count(*) AS rows, count(*) - count(DISTINCT ts) AS repeated, count(*) FILTER (p <= 0 OR low <= 0) AS bad_price, count(*) FILTER (low > p) AS inconsistent FROM r GROUP BY symbol"""


def flt_36_fee_ratio(spark, sf_dir):
    """Round-trip commission of each quote over the risk of its units, and whether its stop lies above the floor for a tenth."""
    q = quotes(spark, sf_dir).select("event_id", "mid", (F.col("event_id") % 50 + 1).cast("double").alias("units"), (F.col("mid") * 0.05).alias("stop"))
    side = F.greatest(F.lit(2.0), 0.0002 * F.col("units") * F.col("mid"))
    return rounded(q.select("event_id", F.try_divide(2 * side, F.col("units") * F.col("stop")).alias("ratio"), (F.col("stop") >= 2 * 2.0 / 0.1 / 50).alias("above_floor")))


FLT_36_SQL = f"WITH {sql.QUOTES}, q AS (SELECT event_id, mid, CAST(event_id % 50 + 1 AS DOUBLE) AS units, mid * 0.05 AS stop FROM quotes) SELECT event_id, {sql.settled('2 * greatest(2.0, 0.0002 * units * mid) / nullif(units * stop, 0)', 'ratio')}, stop >= 2 * 2.0 / 0.1 / 50 AS above_floor FROM q"


def flt_37_safety(spark, sf_dir):
    """Customers as accounts: balance, orders beyond 20 as a short position, mean order as exposure, and a result that forgets orders
    with status P."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"), F.sum("o_totalprice").alias("all"), F.sum(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).otherwise(0.0)).alias("booked"))
    s = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("cash"), (20 - F.col("n")).alias("position"), (F.col("mean") / 300_000).alias("exposure"), (F.col("all") + 1000).alias("equity"), F.col("booked").alias("pnl"))
    return rounded(contracts.snapshot_safety(s, F.lit(1000.0)), 2)


FLT_37_SQL = f"""WITH o AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS mean, sum(o_totalprice) AS total, sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice ELSE 0 END) AS booked FROM orders GROUP BY 1),
s AS (SELECT c_custkey AS id, c_acctbal AS cash, CAST(20 - n AS DOUBLE) AS position, mean / 300000 AS exposure, booked - (total + 1000 - 1000) AS off FROM customer JOIN o ON o_custkey = c_custkey),
r AS (SELECT id, 'negative_cash' AS rule, cash AS value FROM s WHERE cash < 0 UNION ALL SELECT id, 'negative_position', position FROM s WHERE position < 0 UNION ALL SELECT id, 'exposure_above_limit', exposure FROM s WHERE exposure > 1 + 1e-12 UNION ALL SELECT id, 'accounting', off FROM s WHERE abs(off) > 1e-3)
SELECT id, rule, {sql.settled('value', 'value', 2)} FROM r"""


def flt_28_analyst(spark, sf_dir):
    """Hours whose end lies between 7 and 20 UTC may be traded."""
    end = F.hour(F.col("ts") + F.make_dt_interval(hours=F.lit(1)))
    return contracts.analyst(contracts.portable(event_bars(spark, sf_dir, 1), 60), (end >= 7) & (end < 20))


PORTABLE = f"""{sql.event_bars(1, 'hb')}, p0 AS (SELECT *, close - lag(close) OVER ({W}) AS change, CASE WHEN lag(close) OVER ({W}) IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) END AS tr FROM hb),
p1 AS (SELECT *, CASE WHEN change > 0 THEN change ELSE 0 * change END AS up, CASE WHEN change < 0 THEN -change ELSE 0 * change END AS down, abs(change) AS way FROM p0),
p2 AS (SELECT *, {sql.full('avg(tr)', 'tr', 14)} AS a, {sql.full('avg(up)', 'up', 14)} AS gain, {sql.full('avg(down)', 'down', 14)} AS loss, {sql.full('avg(close)', 'close', 20)} AS fast, {sql.full('avg(close)', 'close', 60)} AS slow, {sql.full('sum(way)', 'way', 20)} AS path, abs(close - lag(close, 20) OVER ({W})) AS net FROM p1),
p3 AS (SELECT *, round(CASE WHEN a > 0 THEN a END, 10) AS atr FROM p2), p4 AS (SELECT *, list(atr) FILTER (atr IS NOT NULL) OVER ({W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS seen FROM p3),
pf AS (SELECT symbol, ts, atr, {", ".join(f"greatest(-20.0, least(20.0, (close - lag(close, {k}) OVER ({W})) / atr)) + 0 * (close - lag(close, {k}) OVER ({W})) / atr AS move{k}" for k in (1, 4, 16))}, greatest(-20.0, least(20.0, (fast - slow) / atr)) + 0 * (fast - slow) / atr AS sma_gap, greatest(-20.0, least(20.0, (close - fast) / atr)) + 0 * (close - fast) / atr AS distance,
CASE WHEN gain + loss > 0 THEN (100 * gain / (gain + loss) - 50) / 50 WHEN gain + loss = 0 THEN 0.0 END AS rsi_centered, CASE WHEN path > 0 THEN net / path END AS efficiency,
CASE WHEN atr IS NOT NULL AND len(seen) >= 100 THEN (len(list_filter(seen, lambda x: x < atr)) + (len(list_filter(seen, lambda x: x = atr)) + 1) / 2) / len(seen) END AS volatility_rank,
sin(2 * pi() * ((epoch(ts) + 3600) % 86400) / 86400) AS hour_sin, cos(2 * pi() * ((epoch(ts) + 3600) % 86400) / 86400) AS hour_cos FROM p4)"""
FLT_28_SQL = f"""WITH {PORTABLE} SELECT symbol, ts, CAST(sign(coalesce(sma_gap, 0)) AS INTEGER) AS trend, CAST(coalesce(efficiency >= 0.35, false) AS INTEGER) AS regime,
atr IS NOT NULL AND efficiency IS NOT NULL AND volatility_rank IS NOT NULL AND sma_gap IS NOT NULL AND hour(ts + INTERVAL 1 HOUR) BETWEEN 7 AND 19 AND coalesce(volatility_rank, 1.0) < 0.9 AS tradable FROM pf"""


def win_22_portable(spark, sf_dir):
    """Without the strengths of the candle shapes, which cdl_17_observations has."""
    return rounded(contracts.portable(event_bars(spark, sf_dir, 1), 60))


WIN_22_SQL = f"WITH {PORTABLE} SELECT symbol, ts, {sql.all_settled('atr move1 move4 move16 sma_gap distance rsi_centered efficiency volatility_rank hour_sin hour_cos')} FROM pf"


def fn_30_retracement(spark, sf_dir):
    return rounded(contracts.retracement(event_bars(spark, sf_dir, 1)))


FN_30_SQL = f"""WITH {sql.event_bars(1, 'hb')}, r AS (SELECT *, {sql.full('min(low)', 'low', 12, 'prior')} AS f, {sql.full('max(high)', 'high', 12, 'prior')} AS t FROM hb), w AS (SELECT *, t - f AS w, (close - f) / nullif(t - f, 0) AS fraction FROM r)
SELECT symbol, ts, {sql.settled('fraction', 'fraction')}, coalesce(fraction BETWEEN 0.62 AND 0.79, false) AS inside, {sql.settled('t - 0.79 * w', 'bull_low')}, {sql.settled('t - 0.62 * w', 'bull_high')}, {sql.settled('f + 0.62 * w', 'bear_low')}, {sql.settled('f + 0.79 * w', 'bear_high')} FROM w"""


def agg_38_complete_resample(spark, sf_dir):
    """Bars of four hours only from four hourly ones."""
    return rounded(contracts.complete_buckets(event_bars(spark, sf_dir, 1), 4, 4))


AGG_38_SQL = f"WITH {sql.event_bars(1, 'hb')} SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS ts, {sql.settled('arg_min(open, hb.ts)', 'open')}, {sql.settled('max(high)', 'high')}, {sql.settled('min(low)', 'low')}, {sql.settled('arg_max(close, hb.ts)', 'close')} FROM hb GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, hb.ts) HAVING count(*) = 4"


def reg_07_regime_view(spark, sf_dir):
    return contracts.label_view(reg_06_fx_regime(spark, sf_dir).select("symbol", "ts", F.col("regime").alias("label")))


REG_07_SQL = f"""WITH lb AS (SELECT symbol, ts, regime AS label FROM ({REG_06_SQL})), m AS (SELECT *, lag(label) OVER ({W}) AS before FROM lb), c AS (SELECT *, coalesce(label <> before, false) AS changed FROM m),
r AS (SELECT *, count(*) FILTER (changed) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run, last_value(CASE WHEN changed THEN before END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS previous FROM c)
SELECT symbol, ts, label, row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS age, changed, previous FROM r"""


def join_27_regime_lookup(spark, sf_dir):
    """The regime of each quote's hour, counted."""
    q = quotes(spark, sf_dir).select("symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "mid")
    j = q.join(reg_06_fx_regime(spark, sf_dir), ["symbol", "ts"], "left")
    return rounded(j.groupBy("symbol", "regime").agg(F.count("*").alias("n"), F.avg("mid").alias("mean")))


JOIN_27_SQL = f"WITH {sql.QUOTES}, lb AS ({REG_06_SQL}) SELECT q.symbol, regime, count(*) AS n, {sql.settled('avg(mid)', 'mean')} FROM quotes q LEFT JOIN lb ON lb.symbol = q.symbol AND lb.ts = date_trunc('hour', q.ts) GROUP BY ALL"

PATTERNS = ("doji", "marubozu", "hammer", "bullish_engulfing", "bearish_engulfing", "inside_bar", "outside_bar")
SIDES = ("reversal_bullish", "reversal_bearish", "continuation_bullish", "continuation_bearish", "momentum_bullish", "momentum_bearish")


def _flags(spark, sf_dir, key, values):
    """Bars with 1 for each value that an observation of their time has, else 0; bars without observations stay."""
    seen = observations(spark, sf_dir).withColumn("k", key).groupBy("symbol", "ts").pivot("k", list(values)).agg(F.lit(1))
    return item_bars(spark, sf_dir).select("symbol", "ts").join(seen, ["symbol", "ts"], "left").fillna(0, list(values))


def _flags_sql(key, values):
    return f"WITH {OBSERVATIONS_CTE}, k AS (SELECT symbol, ts, {key} AS k FROM obs) SELECT b.symbol, b.ts, " + ", ".join(f"CAST(count(*) FILTER (k = '{v}') > 0 AS INTEGER) AS {v}" for v in values) + " FROM bars b LEFT JOIN k ON k.symbol = b.symbol AND k.ts = b.ts GROUP BY b.symbol, b.ts"


def join_14_pattern_flags(spark, sf_dir):
    return _flags(spark, sf_dir, F.col("pattern"), PATTERNS)


JOIN_14_SQL = _flags_sql("pattern", PATTERNS)


def join_15_event_flags(spark, sf_dir):
    return _flags(spark, sf_dir, F.concat_ws("_", "family", "orientation"), SIDES)


JOIN_15_SQL = _flags_sql("family || '_' || orientation", SIDES)


def agg_43_recent_counts(spark, sf_dir):
    """Observations of each family within a symbol's last 20 sessions, families without any included."""
    recent = item_bars(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where("n <= 20").select("symbol", "ts")
    j = recent.join(observations(spark, sf_dir).select("symbol", "ts", "family"), ["symbol", "ts"], "left")
    return j.groupBy("symbol").agg(*[F.count_if(F.coalesce(F.col("family") == f, F.lit(False))).alias(f) for f in ("reversal", "continuation", "momentum", "indecision")])


AGG_43_SQL = f"WITH {OBSERVATIONS_CTE}, r AS (SELECT symbol, ts FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 20) SELECT r.symbol, " + ", ".join(f"count(*) FILTER (family = '{f}') AS {f}" for f in ("reversal", "continuation", "momentum", "indecision")) + " FROM r LEFT JOIN obs ON obs.symbol = r.symbol AND obs.ts = r.ts GROUP BY r.symbol"


def agg_34_class_distribution(spark, sf_dir):
    """Rows of each year, their share of rising next closes, first and last; the last bar of a symbol has no target."""
    t = item_bars(spark, sf_dir).select("symbol", "ts", F.year("ts").alias("period"), (F.lead("close").over(by()) > F.col("close")).cast("int").alias("up"))
    return rounded(t.groupBy("symbol", "period").agg(F.count("up").alias("n"), F.coalesce(F.sum("up"), F.lit(0)).alias("up"), F.avg("up").alias("rate"), F.min(F.when(F.col("up").isNotNull(), F.col("ts"))).alias("first"), F.max(F.when(F.col("up").isNotNull(), F.col("ts"))).alias("last"), F.count_if(F.col("up").isNull()).alias("no_target")))


AGG_34_SQL = f"""WITH {sql.BARS}, t AS (SELECT symbol, ts, CAST(year(ts) AS INTEGER) AS period, CAST(lead(close) OVER ({W}) > close AS INTEGER) AS up FROM bars)
SELECT symbol, period, count(up) AS n, CAST(coalesce(sum(up), 0) AS BIGINT) AS up, {sql.settled('avg(up)', 'rate')}, min(ts) FILTER (up IS NOT NULL) AS first, max(ts) FILTER (up IS NOT NULL) AS last, count(*) FILTER (up IS NULL) AS no_target FROM t GROUP BY symbol, period"""


def join_26_other_markets(spark, sf_dir):
    """Training rows of each target: the other markets' bars whose next close is known before 1997, and what they hold."""
    at = F.lit("1997-01-01").cast("timestamp_ntz")
    b = item_bars(spark, sf_dir).withColumns({"next": F.lead("ts").over(by()), "r": F.ln(F.lead("close").over(by()) / F.col("close"))}).where(F.col("next") < at)
    t = b.withColumn("target", F.explode(F.array(*[F.lit(s) for s in ("A", "N", "R")]))).where(F.col("target") != F.col("symbol"))
    return rounded(t.groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("markets"), F.avg("r").alias("mean"), F.max("next").alias("latest")))


JOIN_26_SQL = f"""WITH {sql.BARS}, b AS (SELECT symbol, lead(ts) OVER ({W}) AS nx, ln(lead(close) OVER ({W}) / close) AS r FROM bars)
SELECT t AS target, count(*) AS n, count(DISTINCT symbol) AS markets, {sql.settled('avg(r)', 'mean')}, max(nx) AS latest FROM b, (VALUES ('A'), ('N'), ('R')) AS v(t) WHERE t <> symbol AND nx < TIMESTAMP '1997-01-01' GROUP BY t"""


def agg_40_alert_metrics(spark, sf_dir):
    """Events as delivery attempts of a user's alert through a channel (the type): delivered if any attempt succeeds."""
    e = table(spark, sf_dir, "events").withColumn("ok", F.col("value") > 30)
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    d = e.withColumn("attempt", n).groupBy("user_id", "event_type").agg(F.max("attempt").alias("attempts"), F.bool_or("ok").alias("delivered"), F.max("ts").alias("last_at"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), F.count_if(~F.col("ok")).alias("failed"))
    out = d.groupBy("event_type").agg(F.count("*").alias("alerts"), F.count_if("delivered").alias("delivered"), F.sum("failed").alias("failed_attempts"), F.max("attempts").cast("long").alias("most"), F.max("last_at").cast("timestamp_ntz").alias("last_at"), F.avg("last_value").alias("last_value"))
    return rounded(out)


AGG_40_SQL = f"""WITH d AS (SELECT user_id, event_type, count(*) AS attempts, bool_or(value > 30) AS delivered, max(ts) AS last_at, arg_max(value, row(ts, event_id)) AS last_value, count(*) FILTER (NOT value > 30) AS failed FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS alerts, count(*) FILTER (delivered) AS delivered, CAST(sum(failed) AS BIGINT) AS failed_attempts, max(attempts) AS most, max(last_at) AS last_at, {sql.settled('avg(last_value)', 'last_value')} FROM d GROUP BY event_type"""


def view_04_alert_list(spark, sf_dir):
    """Orders as alerts with the state of their lines as deliveries, and their place from the newest; undelivered ones stay."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("attempts"), F.bool_or(F.col("l_linestatus") == "F").alias("delivered"), F.max("l_shipdate").alias("last_at"))
    o = table(spark, sf_dir, "orders").join(d, "o_orderkey", "left")
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).cast("long")
    return o.select("o_orderkey", "o_orderpriority", place.alias("place"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.when(F.col("attempts").isNull(), "pending").when(F.col("delivered"), "delivered").otherwise("failed").alias("status"), F.col("last_at").cast("timestamp_ntz").alias("last_at"))


VIEW_04_SQL = """WITH d AS (SELECT l_orderkey, count(*) AS attempts, bool_or(l_linestatus = 'F') AS delivered, max(l_shipdate) AS last_at FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS place, coalesce(attempts, 0) AS attempts, CASE WHEN attempts IS NULL THEN 'pending' WHEN delivered THEN 'delivered' ELSE 'failed' END AS status, last_at FROM orders LEFT JOIN d ON l_orderkey = o_orderkey"""


def join_19_reconciliation(spark, sf_dir):
    """Each part's quantity in the local book (lines of status O) beside the broker's (lines not returned): missing, partial, over
    or matched."""
    l = table(spark, sf_dir, "lineitem")
    own = l.where("l_linestatus = 'O'").groupBy("l_partkey").agg(F.sum("l_quantity").alias("local"))
    held = l.where("l_returnflag <> 'R'").groupBy("l_partkey").agg(F.sum("l_quantity").alias("broker"))
    j = own.join(held, "l_partkey", "full").select("l_partkey", "local", "broker")
    cls = F.when(F.col("broker").isNull(), "unfilled").when(F.col("local").isNull(), "unknown_position").when(F.col("broker") < F.col("local"), "partial").when(F.col("broker") > F.col("local"), "mismatch").otherwise("matched")
    return rounded(j.select("l_partkey", "local", "broker", cls.alias("class")))


JOIN_19_SQL = f"""WITH a AS (SELECT l_partkey, sum(l_quantity) AS local FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), b AS (SELECT l_partkey, sum(l_quantity) AS broker FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, {sql.all_settled('local broker')}, CASE WHEN broker IS NULL THEN 'unfilled' WHEN local IS NULL THEN 'unknown_position' WHEN broker < local THEN 'partial' WHEN broker > local THEN 'mismatch' ELSE 'matched' END AS class FROM a FULL JOIN b ON a.l_partkey = b.l_partkey"""


def join_18_expected_quantity(spark, sf_dir):
    """Fill (line) to order to decision (customer) to snapshot (nation's mean balance): the quantity expected, and the difference."""
    snap = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("balance"))
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(snap, "c_nationkey")
    expected = F.floor(F.col("balance") / 200)
    return rounded(j.groupBy("l_orderkey").agg(F.count("*").alias("fills"), F.sum("l_quantity").alias("filled"), F.sum(F.col("l_quantity") - expected).alias("difference")))


JOIN_18_SQL = f"""WITH s AS (SELECT c_nationkey, avg(c_acctbal) AS balance FROM customer GROUP BY 1) SELECT l_orderkey, count(*) AS fills, {sql.settled('sum(l_quantity)', 'filled')}, {sql.settled('sum(l_quantity - floor(balance / 200))', 'difference')}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN s ON s.c_nationkey = c.c_nationkey GROUP BY l_orderkey"""


def agg_16_event_levels(spark, sf_dir):
    """How often each control (order status) acted in a run (nation and priority): none, single, few or several, with the levels of
    a run joined by semicolons (the next row of the inventory)."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    controls = ("F", "O", "P")
    g = j.groupBy("c_nationkey", "o_orderpriority").agg(*[F.count_if(F.col("o_orderstatus") == c).alias(c) for c in controls])
    level = lambda c: F.when(F.col(c) <= 0, "none").when(F.col(c) == 1, "single").when(F.col(c) < 12, "few").otherwise("several")
    return g.select("c_nationkey", "o_orderpriority", F.concat_ws(";", *[F.concat(F.lit(f"{c}:"), level(c)) for c in controls]).alias("levels"), F.concat_ws(";", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in controls]).alias("counts"))


AGG_16_SQL = "WITH g AS (SELECT c_nationkey, o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT c_nationkey, o_orderpriority, " + " || ';' || ".join(f"'{c.upper()}:' || CASE WHEN {c} <= 0 THEN 'none' WHEN {c} = 1 THEN 'single' WHEN {c} < 12 THEN 'few' ELSE 'several' END" for c in "fop") + " AS levels, " + " || ';' || ".join(f"'{c.upper()}=' || {c}" for c in "fop") + " AS counts FROM g"

_NAMES = [k for k in dict(globals()) if k.split("_")[0] in ("flt", "join", "agg", "win", "fn", "reg", "view") and callable(globals()[k]) and f"{'_'.join(k.split('_')[:2]).upper()}_SQL" in globals() and k != "reg_06_fx_regime"]
QUERIES = {k: globals()[k] for k in _NAMES}
SQL = {k: globals()[f"{'_'.join(k.split('_')[:2]).upper()}_SQL"] for k in _NAMES}
