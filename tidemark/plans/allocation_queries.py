"""Queries of cash rates, costs, calendars and run summaries of allocations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.functions.semantics import asof, by, lagged, rolling_mean, rounded
from tidemark.operators import allocation
from tidemark.plans import sql
from tidemark.plans.portfolio_queries import EQUITY_CTE, KEYS, K, equity
from tidemark.sources.bars import item_bars, table

W = sql.W
START = "1996-06-01"


def rates(spark, sf_dir):
    """A rate for each symbol and month, dated at its last day: the mean tax less 3.5 points, so that some are negative."""
    month = F.last_day(F.to_date("l_shipdate")).cast("timestamp_ntz")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), month.alias("ts")).agg((F.avg("l_tax") - 0.035).alias("rate"))


RATES = "rates AS (SELECT l_returnflag AS symbol, CAST(last_day(CAST(l_shipdate AS DATE)) AS TIMESTAMP) AS ts, avg(l_tax) - 0.035 AS rate FROM lineitem GROUP BY 1, 2)"
KNOWN = f"""{RATES}, kr AS (SELECT b.symbol, b.ts, r.rate, r.ts AS dated FROM bars b ASOF LEFT JOIN rates r ON r.symbol = b.symbol AND b.ts >= r.ts),
kn AS (SELECT symbol, ts, lag(rate) OVER ({W}) AS rate, date_diff('day', lag(ts) OVER ({W}), ts) AS gap, dated FROM kr)"""


def weekday_sql(d: str) -> str:
    return f"(date_diff('day', DATE '1900-01-01', {d}) // 7 * 5 + least(date_diff('day', DATE '1900-01-01', {d}) % 7 + 1, 5))"


def join_06_cash_rate(spark, sf_dir):
    """Rate known at the session before, and the calendar days since."""
    return rounded(allocation.known_rates(item_bars(spark, sf_dir), rates(spark, sf_dir), "symbol").withColumn("gap", F.col("gap").cast("long")))


JOIN_06_SQL = f"WITH {sql.BARS}, {KNOWN} SELECT symbol, ts, {sql.settled('rate', 'rate')}, gap FROM kn"


def agg_22_cash_returns(spark, sf_dir):
    return rounded(allocation.cash_returns(item_bars(spark, sf_dir), rates(spark, sf_dir), "symbol"), 9)


AGG_22_SQL = f"WITH {sql.BARS}, {KNOWN} SELECT symbol, ts, {sql.settled('rate * gap / 360', 'cash_return', 9)} FROM kn"


def runs(spark, sf_dir):
    """Days of each strategy's equity: cash returns, what was traded and its cost."""
    e = equity(spark, sf_dir)
    cash = allocation.cash_returns(item_bars(spark, sf_dir), rates(spark, sf_dir), "symbol")
    traded = F.abs(F.col("position") - F.coalesce(F.lag("position").over(by(*KEYS)), F.lit(0.0))) * F.col("equity")
    return e.join(cash, ["symbol", "ts"], "left").select(*KEYS, "ts", F.col("equity").alias("nav"), "cash_return", F.col("position").alias("exposure"), traded.alias("traded"), (traded * 0.0011).alias("cost"))


RUNS_CTE = f"""{EQUITY_CTE}, {KNOWN}, runs AS (SELECT eq.symbol, strategy, eq.ts, equity AS nav, rate * gap / 360 AS cash_return, position AS exposure, abs(position - coalesce(lag(position) OVER (PARTITION BY eq.symbol, strategy ORDER BY eq.ts), 0)) * equity AS traded
FROM eq LEFT JOIN kn ON kn.symbol = eq.symbol AND kn.ts = eq.ts)"""


def agg_21_run_summary(spark, sf_dir):
    return rounded(allocation.summary(runs(spark, sf_dir), *KEYS, capital=100_000.0))


AGG_21_SQL = f"""WITH {RUNS_CTE}, d AS (SELECT *, nav / lag(nav) OVER ({K}) - 1 AS r FROM runs), e AS (SELECT *, r - cash_return AS x FROM d),
mo AS (SELECT symbol, strategy, min(m) AS worst_month FROM (SELECT symbol, strategy, exp(sum(ln(r + 1))) - 1 AS m FROM e WHERE r IS NOT NULL GROUP BY symbol, strategy, date_trunc('month', ts)) GROUP BY ALL),
t AS (SELECT symbol, strategy, count(*) AS sessions, date_diff('day', min(ts), max(ts)) / 365.25 AS years, arg_max(nav, ts) / 100000.0 AS growth, sum(ln(cash_return + 1)) AS cg, stddev_samp(r) AS sd, avg(x) AS mx, stddev_samp(x) AS sx, avg(nav) AS an, sum(traded) AS tr, avg(exposure) AS average_exposure FROM e GROUP BY ALL),
u AS (SELECT *, sqrt((sessions - 1) / years) AS root FROM t)
SELECT u.symbol, u.strategy, sessions, {sql.settled('years', 'years')}, {sql.settled('ln(growth)', 'log_growth')}, {sql.settled('pow(growth, 1 / years) - 1', 'cagr')}, {sql.settled('exp(cg / years) - 1', 'cash_cagr')}, {sql.settled('sd * root', 'volatility')},
{sql.settled('mx / nullif(sx, 0) * root', 'sharpe')}, {sql.settled('worst_month', 'worst_month')}, {sql.settled('tr / an / years', 'turnover')}, {sql.settled('average_exposure', 'average_exposure')}, {sql.settled('100 * tr * 0.0011 / an / years', 'cost_pct')}
FROM u LEFT JOIN mo ON mo.symbol = u.symbol AND mo.strategy = u.strategy"""


def agg_26_ter_drag(spark, sf_dir):
    ter = F.when(F.col("symbol") == "A", 0.2).when(F.col("symbol") == "N", 0.07).otherwise(0.5)
    return rounded(allocation.ter_drag(runs(spark, sf_dir), ter, *KEYS))


AGG_26_SQL = f"""WITH {RUNS_CTE}, h AS (SELECT *, nav * exposure * CASE symbol WHEN 'A' THEN 0.2 WHEN 'N' THEN 0.07 ELSE 0.5 END / 100 * date_diff('day', ts, lead(ts) OVER ({K})) / 365 AS charge FROM runs)
SELECT symbol, strategy, {sql.settled("100 * sum(charge) / avg(nav) / (date_diff('day', min(ts), max(ts)) / 365.25)", 'ter_drag')} FROM h GROUP BY ALL"""

CAPITALS = (1_000, 5_000, 10_000, 25_000, 50_000, 100_000)


def agg_27_viable_capital(spark, sf_dir):
    """Runs of a strategy pooled over symbols; a trade is a change of position."""
    r = runs(spark, sf_dir).groupBy(*KEYS).agg(F.count_if(F.col("traded") > 0).alias("trades"), (F.datediff(F.max("ts"), F.min("ts")) / 365.25).alias("years"))
    return rounded(allocation.viable_capital(r, CAPITALS, "strategy"))


AGG_27_SQL = f"""WITH {RUNS_CTE}, tc AS (SELECT symbol, strategy, count(*) FILTER (traded > 0) AS trades, date_diff('day', min(ts), max(ts)) / 365.25 AS years FROM runs GROUP BY ALL),
c AS (SELECT strategy, capital, 100 * sum(trades * (greatest(3.0, 0.0005 * capital) + 0.0006 * capital)) / sum(capital * years) AS pct FROM tc, (SELECT unnest({list(CAPITALS)}) AS capital) GROUP BY ALL)
SELECT strategy, CAST(capital AS BIGINT) AS capital, {sql.settled('pct', 'cost_pct')}, coalesce(capital = min(capital) FILTER (pct < 0.5) OVER (PARTITION BY strategy), false) AS reference FROM c"""


def agg_30_rate_audit(spark, sf_dir):
    return allocation.rate_audit(item_bars(spark, sf_dir), rates(spark, sf_dir), "symbol")


AGG_30_SQL = f"""WITH {sql.BARS}, {KNOWN}, g AS (SELECT *, {weekday_sql('CAST(ts AS DATE)')} - lag({weekday_sql('CAST(ts AS DATE)')}) OVER ({W}) AS gap FROM rates),
a AS (SELECT symbol, min(ts) AS first, max(ts) AS last, count(*) AS observations, count(*) FILTER (rate <= 0) AS non_positive, CAST(coalesce(max(gap), 0) AS BIGINT) AS max_gap FROM g GROUP BY symbol),
s AS (SELECT symbol, dated, {weekday_sql('CAST(ts AS DATE)')} - {weekday_sql('CAST(dated AS DATE)')} AS stale FROM kn),
c AS (SELECT symbol, count(*) AS checked, count(*) FILTER (dated IS NULL) AS without_rate, CAST(coalesce(max(stale), -1) AS BIGINT) AS max_stale, count(*) FILTER (stale > 5) AS over_limit FROM s GROUP BY symbol) SELECT * FROM a JOIN c USING (symbol)"""


def agg_31_evaluable_window(spark, sf_dir):
    return allocation.evaluable_start(item_bars(spark, sf_dir))


AGG_31_SQL = f"""WITH {sql.BARS}, r AS (SELECT symbol, ts FROM bars QUALIFY row_number() OVER ({W}) = 200), b AS (SELECT symbol AS binding, ts AS ready FROM r ORDER BY ts DESC, symbol DESC LIMIT 1)
SELECT binding, ready, min(ts) AS start FROM bars, b WHERE ts >= ready GROUP BY ALL"""


def fn_20_total_return(spark, sf_dir):
    """A hundredth of the volume is paid on the first day of a month."""
    b = item_bars(spark, sf_dir).withColumn("dividend", F.when(F.dayofmonth("ts") == 1, F.col("volume") / 100))
    return rounded(b.select("symbol", "ts", allocation.total_return_factor().alias("factor")))


FN_20_SQL = f"WITH {sql.BARS} SELECT symbol, ts, {sql.settled(f'(close + CASE WHEN day(ts) = 1 THEN volume / 100 ELSE 0 END) / lag(close) OVER ({W})', 'factor')} FROM bars"


def fn_22_ter_adjustment(spark, sf_dir):
    """Each part as a series of a kind by its size, in each scenario."""
    kind = F.element_at(F.array(F.lit("product_own"), F.lit("proxy"), F.lit("index")), F.col("p_size") % 3 + 1)
    p = table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), (F.col("p_retailprice") / 10_000).alias("eu"), (F.col("p_size") / 100).alias("proxy"), F.explode(F.array(*[F.lit(s) for s, _ in allocation.SCENARIOS])).alias("scenario"))
    return rounded(p.select("p_partkey", "kind", "scenario", allocation.ter_adjustment(*[F.col(c) for c in ("kind", "eu", "proxy", "scenario")]).alias("pct")))


FN_22_SQL = f"""WITH p AS (SELECT p_partkey, ['product_own', 'proxy', 'index'][p_size % 3 + 1] AS kind, p_retailprice / 10000 AS eu, p_size / 100 AS proxy FROM part)
SELECT p_partkey, kind, scenario, {sql.settled("CASE kind WHEN 'product_own' THEN CASE scenario WHEN 'zero' THEN eu WHEN 'realistic' THEN 0.0 ELSE -eu END WHEN 'proxy' THEN CASE scenario WHEN 'zero' THEN proxy WHEN 'realistic' THEN proxy - eu ELSE proxy - 2 * eu END ELSE CASE scenario WHEN 'zero' THEN 0.0 WHEN 'realistic' THEN -eu ELSE -2 * eu END END", 'pct')}
FROM p, (VALUES ('zero'), ('realistic'), ('double')) AS s(scenario)"""


def fn_29_drift_rule(spark, sf_dir):
    """State by the long average; a holding of equal shares at the average of 50 has drifted to the close's share."""
    s = allocation.signal_table(item_bars(spark, sf_dir)).select("symbol", "ts", "state")
    b = item_bars(spark, sf_dir).join(s, ["symbol", "ts"])
    b = b.withColumns({"before": lagged("state"), "actual": F.col("close") / (F.col("close") + rolling_mean("close", 50))})
    return rounded(b.select("symbol", "ts", "state", "actual", allocation.needs_trade(F.col("state"), F.col("before"), F.col("actual"), F.lit(0.5)).alias("trade")))


SIGNAL_CTE = f"""sg0 AS (SELECT *, {sql.full('avg(close)', 'close', 200)} AS sma, ln(close / lag(close) OVER ({W})) AS lr FROM bars), sg1 AS (SELECT *, coalesce(lr = 0, false) AS still FROM sg0),
sg2 AS (SELECT *, row_number() OVER ({W}) - row_number() OVER (PARTITION BY symbol, still ORDER BY ts) AS g FROM sg1), sg3 AS (SELECT *, CASE WHEN still THEN row_number() OVER (PARTITION BY symbol, still, g ORDER BY ts) ELSE 0 END AS streak FROM sg2),
sgn AS (SELECT *, CASE WHEN sma IS NULL THEN 'INSUFFICIENT_DATA' WHEN close > sma THEN 'LONG' ELSE 'CASH' END AS state FROM sg3)"""
FN_29_SQL = f"""WITH {sql.BARS}, {SIGNAL_CTE}, d AS (SELECT *, lag(state) OVER ({W}) AS before, close / (close + {sql.full('avg(close)', 'close', 50)}) AS actual FROM sgn)
SELECT symbol, ts, state, {sql.settled('actual', 'actual')}, coalesce(state <> 'INSUFFICIENT_DATA' AND ((before <> 'INSUFFICIENT_DATA' AND before <> state) OR (state = 'LONG' AND abs(actual - 0.5) / 0.5 > 0.25)), false) AS trade FROM d"""


def win_25_signal_table(spark, sf_dir):
    return rounded(allocation.signal_table(item_bars(spark, sf_dir)))


WIN_25_SQL = f"WITH {sql.BARS}, {SIGNAL_CTE} SELECT symbol, ts, state, {sql.settled(sql.full('stddev_samp(lr)', 'lr', 60) + ' * sqrt(252.0)', 'vol')}, max(streak) OVER ({W} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) > 5 AS stale FROM sgn"


def join_07_policy_row(spark, sf_dir):
    """Each asset's latest state on every day that has an order."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    return allocation.on_calendar(allocation.signal_table(item_bars(spark, sf_dir)), days, ("A", "N", "R"), "state")


JOIN_07_SQL = f"WITH {sql.BARS}, {SIGNAL_CTE}, g AS (SELECT DISTINCT o_orderdate AS ts, unnest(['A', 'N', 'R']) AS symbol FROM orders) SELECT g.ts, g.symbol, state FROM g ASOF LEFT JOIN sgn ON sgn.symbol = g.symbol AND g.ts >= sgn.ts"


def view_25_warm_up(spark, sf_dir):
    return rounded(allocation.warm_up_slice(item_bars(spark, sf_dir), START).select("symbol", "ts", "close", (F.col("ts") == F.col("ref")).alias("reference")))


VIEW_25_SQL = f"""WITH {sql.BARS}, n AS (SELECT *, row_number() OVER ({W}) AS n, max(ts) FILTER (ts <= TIMESTAMP '{START}') OVER (PARTITION BY symbol) AS ref FROM bars), p AS (SELECT *, max(n) FILTER (ts = ref) OVER (PARTITION BY symbol) AS pos FROM n)
SELECT symbol, ts, {sql.settled('close', 'close')}, ts = ref AS reference FROM p WHERE n > pos - 201"""


def view_26_anchors(spark, sf_dir):
    levels = rates(spark, sf_dir).withColumn("level", 100 + F.col("rate") * 1000)
    return rounded(allocation.anchors(item_bars(spark, sf_dir), levels, START))


VIEW_26_SQL = f"""WITH {sql.BARS}, {RATES}, f AS (SELECT symbol, min(ts) AS ts, arg_min(close, ts) AS close FROM bars WHERE ts >= TIMESTAMP '{START}' GROUP BY symbol), l AS (SELECT symbol, ts, 100 + rate * 1000 AS level FROM rates)
SELECT f.symbol, f.ts, {sql.all_settled('close level')}, {sql.settled('close / nullif(level, 0)', 'anchor')} FROM f ASOF LEFT JOIN l ON l.symbol = f.symbol AND f.ts >= l.ts"""


def view_27_cost_table(spark, sf_dir):
    """Commission, half spread and slippage of each supplier, its class by nation, in each scenario."""
    scenario = F.explode(F.map_from_arrays(F.array(*[F.lit(s) for s, _ in allocation.SCENARIOS]), F.array(*[F.lit(f) for _, f in allocation.SCENARIOS]))).alias("scenario", "factor")
    cls = F.when(F.col("s_nationkey") < 8, "core").when(F.col("s_nationkey") < 16, "liquid").otherwise("thin")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", cls.alias("class"), scenario)
    spread = F.when(F.col("class") == "core", 0.0002).when(F.col("class") == "liquid", 0.0005).otherwise(0.0015)
    return rounded(s.select("s_suppkey", "class", "scenario", (F.col("factor") * 0.0005).alias("commission"), (F.col("factor") * 3).alias("commission_min"), (F.col("factor") * spread).alias("half_spread"), (F.col("factor") * spread * 1.5).alias("slippage"), (F.col("factor") * spread * 2.5).alias("side")))


VIEW_27_SQL = f"""WITH s AS (SELECT s_suppkey, CASE WHEN s_nationkey < 8 THEN 'core' WHEN s_nationkey < 16 THEN 'liquid' ELSE 'thin' END AS class, scenario, factor FROM supplier, (VALUES ('zero', 0.0), ('realistic', 1.0), ('double', 2.0)) AS v(scenario, factor)),
p AS (SELECT *, CAST(factor AS DOUBLE) AS f, CASE class WHEN 'core' THEN 0.0002 WHEN 'liquid' THEN 0.0005 ELSE 0.0015 END::DOUBLE AS spread FROM s)
SELECT s_suppkey, class, scenario, {sql.settled('f * 0.0005', 'commission')}, {sql.settled('f * 3', 'commission_min')}, {sql.settled('f * spread', 'half_spread')}, {sql.settled('f * spread * 1.5', 'slippage')}, {sql.settled('f * spread * 2.5', 'side')} FROM p"""

# calendars


def schedules(spark, sf_dir):
    """Weekdays with an order are sessions in New York, those with a shipment in Frankfurt."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    return calendar.schedule(o, "XNYS").unionByName(calendar.schedule(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day")), "XETR"))


def _at(minutes: int, zone: str, day: str = "day", seconds: int = 0) -> str:
    return f"timezone('UTC', timezone('{zone}', CAST({day} AS TIMESTAMP) + to_minutes({minutes}))) + to_seconds({seconds})"


def _schedule(table_name: str, column: str, exchange: str, zone: str, first: int, last: int) -> str:
    return f"SELECT '{exchange}' AS exchange, day, {_at(first, zone)} AS open_utc, {_at(last, zone)} AS close_utc, {_at(last + 30, zone)} AS eligible_at FROM (SELECT DISTINCT CAST({column} AS DATE) AS day FROM {table_name}) WHERE isodow(day) <= 5"


SCHEDULES = f"sch AS ({_schedule('orders', 'o_orderdate', 'XNYS', 'America/New_York', 570, 960)} UNION ALL {_schedule('lineitem', 'l_shipdate', 'XETR', 'Europe/Berlin', 540, 1050)})"


def fn_12_session_times(spark, sf_dir):
    """Sessions with the time at which each may be processed and the next such time."""
    return schedules(spark, sf_dir).withColumn("next_eligible", F.lead("eligible_at").over(by("exchange", ts="day")))


FN_12_SQL = f"WITH {SCHEDULES} SELECT *, lead(eligible_at) OVER (PARTITION BY exchange ORDER BY day) AS next_eligible FROM sch"


def fn_11_auction_window(spark, sf_dir):
    """Windows of the opening auction, and what an order sent at 14:00 UTC of the session's day would meet."""
    w = calendar.auction_windows(schedules(spark, sf_dir).where("exchange = 'XNYS'"))
    now = F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + 14 * 3600).cast("timestamp_ntz")
    reason = F.when(F.col("previous").isNull(), "no_previous_session").when(now < F.col("opens_at"), "not_open").when(now >= F.col("closes_at"), "cutoff_passed").otherwise("")
    return w.select("day", "previous", "opens_at", "closes_at", reason.alias("reason"))


FN_11_SQL = f"""WITH {SCHEDULES}, p AS (SELECT day, lag(day) OVER (ORDER BY day) AS previous FROM sch WHERE exchange = 'XNYS'), w AS (SELECT day, previous, {_at(1140, 'America/New_York', 'previous', 60)} AS opens_at, {_at(568, 'America/New_York', 'day', -60)} AS closes_at FROM p)
SELECT *, CASE WHEN previous IS NULL THEN 'no_previous_session' WHEN day + INTERVAL 14 HOUR < opens_at THEN 'not_open' WHEN day + INTERVAL 14 HOUR >= closes_at THEN 'cutoff_passed' ELSE '' END AS reason FROM w"""


def set_03_calendar_union(spark, sf_dir):
    """Days that either exchange trades, and whether each does."""
    return schedules(spark, sf_dir).groupBy("day").agg(F.bool_or(F.col("exchange") == "XNYS").alias("new_york"), F.bool_or(F.col("exchange") == "XETR").alias("frankfurt"))


SET_03_SQL = f"WITH {SCHEDULES} SELECT day, bool_or(exchange = 'XNYS') AS new_york, bool_or(exchange = 'XETR') AS frankfurt FROM sch GROUP BY day"


def set_07_next_sessions(spark, sf_dir):
    """Sessions after the last processed one up to a day."""
    return schedules(spark, sf_dir).where("day > DATE '1995-03-03' AND day <= DATE '1995-06-03'").select("exchange", "day")


SET_07_SQL = f"WITH {SCHEDULES} SELECT exchange, day FROM sch WHERE day > DATE '1995-03-03' AND day <= DATE '1995-06-03'"


def topk_10_latest_eligible(spark, sf_dir):
    """Latest session that may be processed at 20:45 UTC of each day with a shipment."""
    now = F.timestamp_seconds(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + 20 * 3600 + 45 * 60).cast("timestamp_ntz")
    nows = table(spark, sf_dir, "lineitem").select(now.alias("ts")).distinct().withColumn("exchange", F.explode(F.array(F.lit("XNYS"), F.lit("XETR"))))
    return asof(nows, schedules(spark, sf_dir).select("exchange", F.col("eligible_at").alias("ts"), "day"), "day", "exchange")


TOPK_10_SQL = f"WITH {SCHEDULES}, n AS (SELECT DISTINCT CAST(l_shipdate AS DATE) + INTERVAL 1245 MINUTE AS ts, unnest(['XNYS', 'XETR']) AS exchange FROM lineitem) SELECT n.ts, n.exchange, s.day FROM n ASOF LEFT JOIN sch s ON s.exchange = n.exchange AND n.ts >= s.eligible_at"


def flt_35_freshness(spark, sf_dir):
    """Sessions in New York that ended after a symbol's last bar of each year, by 15:00 UTC of 5 January, and the market then."""
    last = item_bars(spark, sf_dir).groupBy("symbol", F.year("ts").alias("y")).agg(F.to_date(F.max("ts")).alias("last"))
    s = schedules(spark, sf_dir).where("exchange = 'XNYS'").withColumn("y", F.explode(F.array(F.year("day"), F.year("day") - 1)))
    j = last.join(s, "y", "left").withColumn("now", F.make_timestamp_ntz(F.col("y") + 1, F.lit(1), F.lit(5), F.lit(15), F.lit(0), F.lit(0)))
    today = F.col("day") == F.to_date("now")
    status = F.when(~F.coalesce(F.bool_or(today), F.lit(False)), "no session today").when(F.bool_or(today & (F.col("now") < F.col("open_utc"))), "before the session").when(F.bool_or(today & (F.col("now") < F.col("close_utc"))), "in session").otherwise("after the session")
    done = F.col("close_utc") <= F.col("now")
    return j.groupBy("symbol", "y", "last").agg(F.max(F.when(done, F.col("day"))).alias("expected"), F.count_if(done & (F.col("day") > F.col("last"))).alias("missing"), status.alias("status"))


FLT_35_SQL = f"""WITH {sql.BARS}, {SCHEDULES}, l AS (SELECT symbol, CAST(year(ts) AS INTEGER) AS y, CAST(max(ts) AS DATE) AS last, make_timestamp(year(ts) + 1, 1, 5, 15, 0, 0) AS now FROM bars GROUP BY symbol, year(ts)),
j AS (SELECT l.*, s.day, s.open_utc, s.close_utc, s.day = CAST(now AS DATE) AS today FROM l LEFT JOIN sch s ON s.exchange = 'XNYS' AND year(s.day) IN (y, y + 1))
SELECT symbol, y, last, max(day) FILTER (close_utc <= now) AS expected, count(*) FILTER (close_utc <= now AND day > last) AS missing,
CASE WHEN NOT coalesce(bool_or(today), false) THEN 'no session today' WHEN bool_or(today AND now < open_utc) THEN 'before the session' WHEN bool_or(today AND now < close_utc) THEN 'in session' ELSE 'after the session' END AS status FROM j GROUP BY symbol, y, last"""


def agg_23_excess_sharpe(spark, sf_dir):
    """Sharpe of the excess of each symbol's closes over cash, at its own sessions a year."""
    cash = allocation.cash_returns(item_bars(spark, sf_dir), rates(spark, sf_dir), "symbol")
    x = item_bars(spark, sf_dir).withColumn("r", F.ln(F.col("close") / lagged("close"))).join(cash, ["symbol", "ts"]).withColumn("x", F.col("r") - F.col("cash_return"))
    years = F.datediff(F.max("ts"), F.min("ts")) / 365.25
    return rounded(x.groupBy("symbol").agg((F.try_divide(F.avg("x"), F.stddev_samp("x")) * F.sqrt((F.count("*") - 1) / years)).alias("sharpe"), F.count("x").alias("n")))


AGG_23_SQL = f"""WITH {sql.BARS}, {KNOWN}, x AS (SELECT symbol, ts, ln(close / lag(close) OVER ({W})) AS r FROM bars), y AS (SELECT x.symbol, x.ts, r - rate * gap / 360 AS x FROM x JOIN kn ON kn.symbol = x.symbol AND kn.ts = x.ts)
SELECT symbol, {sql.settled("avg(x) / nullif(stddev_samp(x), 0) * sqrt((count(*) - 1) / (date_diff('day', min(ts), max(ts)) / 365.25))", 'sharpe')}, count(x) AS n FROM y GROUP BY symbol"""

_NAMES = [k for k in dict(globals()) if k.split("_")[0] in ("flt", "join", "agg", "win", "topk", "set", "fn", "view") and callable(globals()[k]) and f"{'_'.join(k.split('_')[:2]).upper()}_SQL" in globals()]
QUERIES = {k: globals()[k] for k in _NAMES}
SQL = {k: globals()[f"{'_'.join(k.split('_')[:2]).upper()}_SQL"] for k in _NAMES}
