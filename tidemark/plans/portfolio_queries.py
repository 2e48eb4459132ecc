"""Queries of simulated equity and its metrics, comparisons and resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import correlation, rounded
from tidemark.operators import indicators, metrics, portfolio, statistics, strategies
from tidemark.plans import sql
from tidemark.plans.indicator_queries import STATES_CTE, features
from tidemark.sources.bars import item_bars

KEYS = ("symbol", "strategy")


def signals(spark, sf_dir, chosen=strategies.BASELINES):
    bars = item_bars(spark, sf_dir)
    seen = indicators.windowed(bars)
    if not {f for s in chosen for f in s.features} <= set(seen.columns):
        seen = features(spark, sf_dir)
    return bars, strategies.targets(strategies.states(seen, chosen)).select("symbol", "ts", "strategy", "target")


def equity(spark, sf_dir, chosen=strategies.BASELINES):
    bars, targets = signals(spark, sf_dir, chosen)
    return metrics.with_returns(portfolio.zero_cost_equity(targets, bars, *KEYS), *KEYS)


K = "PARTITION BY symbol, strategy ORDER BY ts"
EQUITY_CTE = f"""{STATES_CTE.removeprefix("WITH ")},
s0 AS (SELECT sig.symbol, sig.ts, bars.open, bars.close, strategy, CASE state WHEN 'LONG' THEN 1.0 WHEN 'FLAT' THEN 0.0 END AS asked FROM sig JOIN bars ON bars.symbol = sig.symbol AND bars.ts = sig.ts),
s1 AS (SELECT *, CAST(coalesce(last_value(asked IGNORE NULLS) OVER ({K} ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE) AS target FROM s0),
s2 AS (SELECT *, coalesce(lag(target) OVER ({K}), 0.0) AS position FROM s1),
s3 AS (SELECT *, coalesce(lag(position) OVER ({K}), 0.0) AS held, lag(close) OVER ({K}) AS last FROM s2),
s4 AS (SELECT *, CASE WHEN position > 0 AND held > 0 THEN close / last WHEN position > 0 THEN close / open WHEN held > 0 THEN open / last ELSE 1.0 END AS factor FROM s3),
s5 AS (SELECT *, 100000.0 * exp(sum(ln(factor)) OVER ({K} ROWS UNBOUNDED PRECEDING)) AS equity FROM s4),
eq AS (SELECT *, equity / nullif(coalesce(lag(equity) OVER ({K}), 100000.0), 0) - 1 AS daily_return, greatest(max(equity) OVER ({K} ROWS UNBOUNDED PRECEDING), 100000.0) AS running_peak,
  equity / greatest(max(equity) OVER ({K} ROWS UNBOUNDED PRECEDING), 100000.0) - 1 AS drawdown FROM s5)"""

METRICS_CTE = f"""
isl AS (SELECT symbol, strategy, drawdown < 0 AS f, row_number() OVER ({K}) - row_number() OVER (PARTITION BY symbol, strategy, drawdown < 0 ORDER BY ts) AS g FROM eq),
lens AS (SELECT symbol, strategy, f, g, count(*) AS n FROM isl GROUP BY ALL),
longest AS (SELECT symbol, strategy, coalesce(max(n) FILTER (f), 0) AS max_drawdown_sessions FROM lens GROUP BY ALL),
met AS (SELECT symbol, strategy, count(*) AS sessions, arg_max(equity, ts) AS final_equity, arg_max(equity, ts) / 100000.0 - 1 AS cumulative_return, pow(arg_max(equity, ts) / 100000.0, 252.0 / count(*)) - 1 AS cagr,
  stddev_samp(daily_return) * sqrt(252.0) AS annualized_volatility, avg(daily_return) / nullif(stddev_samp(daily_return), 0) * sqrt(252.0) AS sharpe,
  avg(daily_return) / nullif(sqrt(avg(pow(least(daily_return, 0.0), 2))), 0) * sqrt(252.0) AS sortino, min(drawdown) AS max_drawdown, count(*) FILTER (daily_return IS NULL) AS undefined_returns FROM eq GROUP BY ALL)"""
METRIC_DOUBLES = "cumulative_return cagr annualized_volatility sharpe sortino max_drawdown"


def _scaled(df):
    """Final equity goes over many magnitudes: its logarithm is compared."""
    return rounded(df.withColumn("log_equity", F.ln("final_equity")).drop("final_equity"))


def m1_trend_metrics(spark, sf_dir):
    return _scaled(metrics.return_metrics(equity(spark, sf_dir, (strategies.SMA_TREND,)), *KEYS)).drop("cumulative_return")


M1_SQL = f"WITH {EQUITY_CTE}, {METRICS_CTE} SELECT met.symbol, met.strategy, sessions, {sql.all_settled('cagr annualized_volatility sharpe sortino max_drawdown')}, {sql.settled('ln(final_equity)', 'log_equity')}, undefined_returns, max_drawdown_sessions FROM met JOIN longest ON longest.symbol = met.symbol AND longest.strategy = met.strategy WHERE met.strategy = 'sma_trend'"


def agg_05_return_metrics(spark, sf_dir):
    return _scaled(metrics.return_metrics(equity(spark, sf_dir), *KEYS)).drop("cumulative_return")


AGG_05_SQL = M1_SQL.removesuffix(" WHERE met.strategy = 'sma_trend'")


def agg_03_drawdown(spark, sf_dir):
    return rounded(equity(spark, sf_dir).select("symbol", "strategy", "ts", "position", "daily_return", "drawdown"))


AGG_03_SQL = f"WITH {EQUITY_CTE} SELECT symbol, strategy, ts, {sql.all_settled('position daily_return drawdown')} FROM eq"


def agg_11_concentration(spark, sf_dir):
    return rounded(metrics.concentration(equity(spark, sf_dir), *KEYS).withColumnRenamed("log_growth_without_best", "log_rest"))


AGG_11_SQL = f"""WITH {EQUITY_CTE}, rk AS (SELECT symbol, strategy, ln(daily_return + 1) AS l, row_number() OVER (PARTITION BY symbol, strategy ORDER BY daily_return DESC, ts) AS r, count(*) OVER (PARTITION BY symbol, strategy) AS n FROM eq)
SELECT symbol, strategy, {sql.settled("sum(l) FILTER (r > 10)", "log_rest")}, {sql.settled("sum(l) FILTER (r <= ceil(n * 0.01)) / nullif(sum(l), 0)", "top_share")} FROM rk GROUP BY ALL"""


def agg_25_subperiods(spark, sf_dir):
    return rounded(metrics.subperiods(equity(spark, sf_dir), *KEYS).select(*KEYS, F.col("part").cast("long").alias("part"), "sessions", F.col("log_growth").alias("log_return")))


AGG_25_SQL = f"WITH {EQUITY_CTE}, t AS (SELECT *, ntile(4) OVER ({K}) AS part FROM eq) SELECT symbol, strategy, part, count(*) AS sessions, {sql.settled('sum(ln(daily_return + 1))', 'log_return')} FROM t GROUP BY symbol, strategy, part"


def _pairs(e):
    """Each two strategies of a session side by side, as a and b: its few strategies are gathered, so that what gives them runs once."""
    met = e.where("symbol is not null and ts is not null").groupBy("symbol", "ts").agg(F.collect_list(F.struct("strategy", "position", "daily_return")).alias("met"))
    one = met.select("symbol", "met", F.explode("met").alias("a"))
    return one.select("symbol", "a", F.explode(F.filter("met", lambda b: F.col("a.strategy") < b["strategy"])).alias("b"))


def agg_12_redundancy(spark, sf_dir):
    """Agreement, correlation and differing sessions of each unordered pair of strategies."""
    return rounded(
        _pairs(equity(spark, sf_dir)).groupBy("symbol", F.col("a.strategy").alias("first"), F.col("b.strategy").alias("second")).agg(
            F.avg((F.col("a.position") == F.col("b.position")).cast("double")).alias("agreement"), correlation("a.daily_return", "b.daily_return").alias("correlation"),
            F.count_if(F.abs(F.col("a.position") - F.col("b.position")) > 1e-12).alias("differing"),
        )
    )


AGG_12_SQL = f"""WITH {EQUITY_CTE} SELECT a.symbol, a.strategy AS first, b.strategy AS second, {sql.settled("avg(CASE WHEN a.position = b.position THEN 1.0 ELSE 0.0 END)", "agreement")}, {sql.settled("corr(a.daily_return, b.daily_return)", "correlation")},
  count(*) FILTER (abs(a.position - b.position) > 1e-12) AS differing FROM eq a JOIN eq b ON a.symbol = b.symbol AND a.ts = b.ts AND a.strategy < b.strategy GROUP BY ALL"""


def src_30_returns_matrix(spark, sf_dir):
    wide = equity(spark, sf_dir).groupBy("symbol", "ts").pivot("strategy", [s.name for s in strategies.BASELINES]).agg(F.first("daily_return"))
    return rounded(wide)


SRC_30_SQL = f"WITH {EQUITY_CTE} SELECT symbol, ts, " + ", ".join(sql.settled(f"max(daily_return) FILTER (strategy = '{s}')", s) for s in "buy_and_hold sma_trend sma_crossover rsi_momentum price_action_trend regime_trend".split()) + " FROM eq GROUP BY symbol, ts"


def sim_02_simulation(spark, sf_dir):
    """Fold with costs; checked against brute force in tests."""
    bars, targets = signals(spark, sf_dir)
    return portfolio.simulate(targets, bars, *KEYS)


def sim_05_trades(spark, sf_dir):
    bars, targets = signals(spark, sf_dir)
    return portfolio.trades(targets, bars, *KEYS)


def sim_06_open_positions(spark, sf_dir):
    bars, targets = signals(spark, sf_dir)
    return portfolio.open_positions(targets, bars, *KEYS)


def sim_07_fills(spark, sf_dir):
    bars, targets = signals(spark, sf_dir)
    return portfolio.fills(targets, bars, *KEYS)


#: What an order costs in the metrics below, in basis points of its notional.
BPS = 3.0


def _net(spark, sf_dir):
    bars, targets = signals(spark, sf_dir)
    return bars, targets, portfolio.proportional(targets, bars, *KEYS, bps=BPS)


def stat_10_one_sided(spark, sf_dir):
    """Of the net returns of closed trades."""
    trips = portfolio.round_trips(_net(spark, sf_dir)[2], *KEYS, bps=BPS)
    return statistics.one_sided(trips.select(*KEYS, F.col("entry_ts").alias("ts"), F.col("net_return").alias("r")), *KEYS)


def agg_06_trade_metrics(spark, sf_dir):
    return rounded(metrics.trade_metrics(portfolio.round_trips(_net(spark, sf_dir)[2], *KEYS, bps=BPS), *KEYS))


def agg_07_activity(spark, sf_dir):
    """Costs go over many magnitudes: their logarithm is compared."""
    out = metrics.activity_metrics(_net(spark, sf_dir)[2], *KEYS)
    return rounded(out.withColumn("log_costs", F.ln("total_costs")).drop("total_costs"))


def agg_08_all_metrics(spark, sf_dir):
    """Net, gross, trades and activity in one row."""
    bars, targets, equity_net = _net(spark, sf_dir)
    net = metrics.return_metrics(metrics.with_returns(equity_net, *KEYS), *KEYS)
    gross = metrics.return_metrics(metrics.with_returns(portfolio.zero_cost_equity(targets, bars, *KEYS), *KEYS), *KEYS)
    gross = gross.select(*KEYS, F.ln("final_equity").alias("gross_log_equity"), F.col("cagr").alias("gross_cagr"), F.col("sharpe").alias("gross_sharpe"))
    active = metrics.activity_metrics(equity_net, *KEYS).select(*KEYS, "exposure", "orders", "turnover")
    traded = metrics.trade_metrics(portfolio.round_trips(equity_net, *KEYS, bps=BPS), *KEYS)
    out = net.withColumn("log_equity", F.ln("final_equity")).drop("final_equity", "cumulative_return").join(gross, list(KEYS)).join(traded, list(KEYS), "left").join(active, list(KEYS))
    return rounded(out.withColumn("cost_drag", F.col("gross_log_equity") - F.col("log_equity")))


_C = BPS / 1e4
NET_CTE = f"""
n0 AS (SELECT *, position > 0 AND held <= 0 AS buys, held > 0 AND position <= 0 AS sells FROM s4),
n1 AS (SELECT *, 100000.0 * exp(sum(ln(factor) + CASE WHEN buys THEN -ln(1 + {_C!r}::DOUBLE) WHEN sells THEN ln(1 - {_C!r}::DOUBLE) ELSE 0 END) OVER ({K} ROWS UNBOUNDED PRECEDING)) AS equity, row_number() OVER ({K}) AS i FROM n0),
n2 AS (SELECT *, coalesce(lag(equity) OVER ({K}), 100000.0) AS cash FROM n1),
n3 AS (SELECT *, CASE WHEN buys THEN cash / (1 + {_C!r}::DOUBLE) WHEN sells THEN cash * open / last ELSE 0.0 END AS traded, last_value(CASE WHEN buys THEN {{'ts': ts, 'open': open, 'cash': cash, 'i': i}} END IGNORE NULLS) OVER ({K} ROWS UNBOUNDED PRECEDING) AS e FROM n2),
n4 AS (SELECT symbol, strategy, e.ts AS entry_ts, open * (1 - {_C!r}::DOUBLE) / (e.open * (1 + {_C!r}::DOUBLE)) - 1 AS net_return, e.cash * (open * (1 - {_C!r}::DOUBLE) / (e.open * (1 + {_C!r}::DOUBLE)) - 1) AS net_pnl, i - e.i AS holding FROM n3 WHERE sells),
n5 AS (SELECT *, row_number() OVER (PARTITION BY symbol, strategy, net_pnl > 0 ORDER BY net_pnl DESC, entry_ts) AS place FROM n4),
tm AS (SELECT symbol, strategy, count(*) AS completed_trades, avg((net_return > 0)::INT) AS win_rate, avg(net_return) AS avg_trade, median(net_return) AS median_trade, max(net_return) AS best_trade, min(net_return) AS worst_trade, avg(holding) AS avg_holding,
  sum(net_pnl) FILTER (net_pnl > 0 AND place <= 5) / nullif(sum(net_pnl) FILTER (net_pnl > 0), 0) AS top5_share FROM n5 GROUP BY symbol, strategy),
am AS (SELECT symbol, strategy, avg(position) AS exposure, count(*) FILTER (buys OR sells) AS orders, sum(traded) / avg(equity) AS turnover, sum(traded) / avg(equity) * 252 / count(*) AS annualized_turnover, sum(traded * {_C!r}::DOUBLE) AS costs FROM n3 GROUP BY symbol, strategy)"""
_TRADED = "win_rate avg_trade median_trade best_trade worst_trade avg_holding top5_share"
AGG_06_SQL = f"WITH {EQUITY_CTE}, {NET_CTE} SELECT symbol, strategy, completed_trades, {sql.all_settled(_TRADED)} FROM tm"
AGG_07_SQL = f"WITH {EQUITY_CTE}, {NET_CTE} SELECT symbol, strategy, orders, {sql.all_settled('exposure turnover annualized_turnover')}, {sql.settled('ln(nullif(costs, 0))', 'log_costs')} FROM am"
_NET_METRICS = METRICS_CTE.replace("isl", "nisl").replace("lens", "nlens").replace("longest", "nlongest").replace("met AS", "nmet AS").replace("FROM eq", "FROM neq")
AGG_08_SQL = f"""WITH {EQUITY_CTE}, {METRICS_CTE}, {NET_CTE},
neq AS (SELECT *, equity / nullif(coalesce(lag(equity) OVER ({K}), 100000.0), 0) - 1 AS daily_return, equity / greatest(max(equity) OVER ({K} ROWS UNBOUNDED PRECEDING), 100000.0) - 1 AS drawdown FROM n1), {_NET_METRICS}
SELECT n.symbol, n.strategy, n.sessions, {", ".join(sql.settled(f"n.{c}", c) for c in "cagr annualized_volatility sharpe sortino max_drawdown".split())}, n.undefined_returns, l.max_drawdown_sessions, {sql.settled('ln(n.final_equity)', 'log_equity')},
  {sql.settled('ln(met.final_equity)', 'gross_log_equity')}, {sql.settled('met.cagr', 'gross_cagr')}, {sql.settled('met.sharpe', 'gross_sharpe')}, completed_trades, {", ".join(sql.settled(f"tm.{c}", c) for c in _TRADED.split())}, {sql.settled('am.exposure', 'exposure')}, am.orders, {sql.settled('am.turnover', 'turnover')},
  {sql.settled('ln(met.final_equity) - ln(n.final_equity)', 'cost_drag')}
FROM nmet n JOIN nlongest l ON l.symbol = n.symbol AND l.strategy = n.strategy JOIN met ON met.symbol = n.symbol AND met.strategy = n.strategy LEFT JOIN tm ON tm.symbol = n.symbol AND tm.strategy = n.strategy JOIN am ON am.symbol = n.symbol AND am.strategy = n.strategy"""


def sim_08_benchmark(spark, sf_dir):
    """Price and total-return growth of holding from the first open."""
    w = Window.partitionBy("symbol").orderBy("ts")
    bars = item_bars(spark, sf_dir)
    first = F.first(F.struct("open", "close", "adj_close")).over(w)
    return rounded(bars.select("symbol", "ts", (F.ln(F.col("close") / first["open"])).alias("log_price"), F.ln(F.col("adj_close") / (first["open"] * first["adj_close"] / first["close"])).alias("log_total")))


SIM_08_SQL = f"WITH {sql.BARS}, f AS (SELECT *, first_value(open) OVER ({sql.W}) AS o1, first_value(close) OVER ({sql.W}) AS c1, first_value(adj_close) OVER ({sql.W}) AS a1 FROM bars) SELECT symbol, ts, {sql.settled('ln(close / o1)', 'log_price')}, {sql.settled('ln(adj_close / (o1 * a1 / c1))', 'log_total')} FROM f"

# statistics


def p_values(spark, sf_dir):
    """A family of p-values: the share of returns of each priority's orders beyond each status's mean."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("name")).agg(F.round(F.count_if(F.col("o_totalprice") > 400_000) / F.count("*"), 9).alias("p"))


P_CTE = "p AS (SELECT o_orderpriority || '|' || o_orderstatus AS name, round(count(*) FILTER (o_totalprice > 400000) / count(*), 9) AS p FROM orders GROUP BY ALL)"


def stat_05_holm(spark, sf_dir):
    return rounded(statistics.adjust(p_values(spark, sf_dir)))


STAT_05_SQL = f"""WITH {P_CTE}, r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM p)
SELECT name, {sql.settled("p", "p")}, {sql.settled("least(1.0, max((m - k + 1) * p) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING))", "p_holm")}, {sql.settled("least(1.0, min(p * m / k) OVER (ORDER BY p DESC, name DESC ROWS UNBOUNDED PRECEDING))", "p_bh")}, m AS family_size FROM r"""


def stat_03_bootstrap(spark, sf_dir):
    return statistics.bootstrap(equity(spark, sf_dir).select("symbol", "strategy", "ts", "daily_return"), "symbol", "strategy", resamples=2000, block=21, seed=7)


def agg_46_interval(spark, sf_dir):
    return rounded(equity(spark, sf_dir).groupBy(*KEYS).agg(F.percentile("daily_return", F.lit(0.025)).alias("low"), F.percentile("daily_return", F.lit(0.5)).alias("middle"), F.percentile("daily_return", F.lit(0.975)).alias("high"), F.count("daily_return").alias("n")))


AGG_46_SQL = f"WITH {EQUITY_CTE} SELECT symbol, strategy, {sql.settled('quantile_cont(daily_return, 0.025)', 'low')}, {sql.settled('quantile_cont(daily_return, 0.5)', 'middle')}, {sql.settled('quantile_cont(daily_return, 0.975)', 'high')}, count(daily_return) AS n FROM eq GROUP BY symbol, strategy"

QUERIES = {
    "m1_trend_metrics": m1_trend_metrics, "agg_05_return_metrics": agg_05_return_metrics, "agg_03_drawdown": agg_03_drawdown, "agg_11_concentration": agg_11_concentration, "agg_25_subperiods": agg_25_subperiods, "agg_12_redundancy": agg_12_redundancy,
    "src_30_returns_matrix": src_30_returns_matrix, "sim_02_simulation": sim_02_simulation, "sim_05_trades": sim_05_trades, "sim_06_open_positions": sim_06_open_positions, "sim_07_fills": sim_07_fills, "stat_10_one_sided": stat_10_one_sided, "agg_06_trade_metrics": agg_06_trade_metrics, "agg_07_activity": agg_07_activity, "agg_08_all_metrics": agg_08_all_metrics,
    "sim_08_benchmark": sim_08_benchmark, "stat_05_holm": stat_05_holm, "stat_03_bootstrap": stat_03_bootstrap, "agg_46_interval": agg_46_interval,
}
SQL = {
    "agg_06_trade_metrics": AGG_06_SQL, "agg_07_activity": AGG_07_SQL, "agg_08_all_metrics": AGG_08_SQL, "m1_trend_metrics": M1_SQL, "agg_05_return_metrics": AGG_05_SQL, "agg_03_drawdown": AGG_03_SQL, "agg_11_concentration": AGG_11_SQL, "agg_25_subperiods": AGG_25_SQL, "agg_12_redundancy": AGG_12_SQL,
    "src_30_returns_matrix": SRC_30_SQL, "sim_08_benchmark": SIM_08_SQL, "stat_05_holm": STAT_05_SQL, "agg_46_interval": AGG_46_SQL,
}
