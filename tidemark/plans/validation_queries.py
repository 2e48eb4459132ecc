"""Queries of scenarios, gates, comparisons and timing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.semantics import by, rounded
from tidemark.operators import features, labels, statistics, strategies, trees, validation
from tidemark.plans import sql
from tidemark.plans.label_queries import _BARS, _FLOOR, RULES, _bars
from tidemark.plans.portfolio_queries import EQUITY_CTE, equity, signals
from tidemark.sources.bars import item_bars

#: Scenarios of costs in basis points of an order's notional.
SCENARIOS = [("free", 0.0), ("base", 3.0), ("double", 6.0), ("stress", 12.0)]
MIDDLE = "1995-06-17"


def _cube(spark, sf_dir):
    bars, targets = signals(spark, sf_dir)
    part = F.when(F.col("ts") < F.lit(MIDDLE).cast("timestamp_ntz"), "early").otherwise("late")
    return validation.scenario_cube(targets, bars, spark.createDataFrame(SCENARIOS, "scenario string, bps double"), part)


def stat_04_scenarios(spark, sf_dir):
    """Three slices, four scenarios, six strategies of each symbol (AGG-13)."""
    return rounded(_cube(spark, sf_dir))


CUBE = f"""{EQUITY_CTE}, sc(scenario, c) AS (VALUES {", ".join(f"('{n}', {b / 1e4!r}::DOUBLE)" for n, b in SCENARIOS)}),
cu_g AS (SELECT symbol, strategy, scenario, CASE WHEN ts < TIMESTAMP '{MIDDLE}' THEN 'early' ELSE 'late' END AS slice, ts, CASE WHEN position > 0 AND held <= 0 THEN -ln(1 + c) WHEN held > 0 AND position <= 0 THEN ln(1 - c) ELSE 0.0 END AS cost,
      CAST((position > 0) <> (held > 0) AS INTEGER) AS ord, ln(factor) AS free FROM s4, sc),
cu_u AS (SELECT symbol, strategy, scenario, slice, ts, cost, ord, free + cost AS growth FROM cu_g UNION ALL SELECT symbol, strategy, scenario, 'full', ts, cost, ord, free + cost FROM cu_g),
cu_v AS (SELECT *, sum(growth) OVER p AS level FROM cu_u WINDOW p AS (PARTITION BY symbol, strategy, scenario, slice ORDER BY ts ROWS UNBOUNDED PRECEDING)),
cu_w AS (SELECT *, exp(level - greatest(max(level) OVER p, 0)) - 1 AS fall, exp(growth) - 1 AS r FROM cu_v WINDOW p AS (PARTITION BY symbol, strategy, scenario, slice ORDER BY ts ROWS UNBOUNDED PRECEDING)),
cube AS (SELECT symbol, strategy, scenario, slice, count(*) AS sessions, sum(growth) AS log_growth, avg(r) AS mean, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0) AS sharpe, min(fall) AS max_drawdown, sum(ord) AS orders, sum(cost) AS log_costs FROM cu_w GROUP BY ALL)"""
STAT_04_SQL = f"WITH {CUBE} SELECT symbol, strategy, scenario, slice, sessions, {sql.all_settled('log_growth mean sharpe max_drawdown')}, orders, {sql.settled('log_costs', 'log_costs')} FROM cube"

#: Yearly growth of cash that a strategy has to beat, and the share of a year's sessions.
CASH = 0.02


def stat_13_gates(spark, sf_dir):
    """Six gates of each strategy over all symbols, of which each holds a third, against holding; and the verdict with the lower bound that the Sharpe ratio's standard error gives."""
    cube = _cube(spark, sf_dir)
    full = cube.where("slice = 'full'")
    mine = full.groupBy("strategy").agg(
        F.avg(F.when(F.col("scenario") == "base", F.col("sharpe"))).alias("sharpe"), F.avg(F.when(F.col("scenario") == "base", -F.col("max_drawdown"))).alias("max_drawdown"), F.avg(F.when(F.col("scenario") == "double", F.col("log_growth"))).alias("double_return"),
        F.avg(F.when(F.col("scenario") == "base", F.col("log_growth") / F.col("sessions") * 252)).alias("__yearly"), F.max("sessions").alias("sessions"),
        F.array_sort(F.collect_list(F.when(F.col("scenario") == "base", F.col("log_growth")))).alias("profits"),
    ).withColumns({"cagr": F.exp("__yearly") - 1, "cash_cagr": F.lit(CASH)})
    parts = cube.where("slice <> 'full' and scenario in ('base', 'double')").groupBy("strategy", "slice", "scenario").agg(F.avg("log_growth").alias("g")).groupBy("strategy").agg(F.array_sort(F.collect_list("g")).alias("parts"))
    held = mine.where("strategy = 'buy_and_hold'").select(F.col("sharpe").alias("benchmark_sharpe"), F.col("max_drawdown").alias("benchmark_drawdown"))
    out = validation.gates(mine.join(parts, "strategy").join(F.broadcast(held)))
    error = F.sqrt((1 + F.col("sharpe") * F.col("sharpe") / 2 / 252) * 252 / F.col("sessions"))
    out = out.withColumn("lower", F.col("sharpe") - 1.645 * error).withColumn("verdict", validation.verdict(F.col("passed"), F.col("lower"), F.col("sharpe").isNull()))
    return rounded(out.select("strategy", "cagr", "sharpe", "max_drawdown", "gate_cash", "gate_sharpe", "gate_drawdown", "gate_costs", "gate_parts", "gate_spread", "passed", "lower", "verdict"))


STAT_13_SQL = f"""WITH {CUBE}, gt_m AS (SELECT strategy, avg(sharpe) FILTER (scenario = 'base') AS sharpe, avg(-max_drawdown) FILTER (scenario = 'base') AS max_drawdown, avg(log_growth) FILTER (scenario = 'double') AS dbl,
  exp(avg(log_growth / sessions * 252) FILTER (scenario = 'base')) - 1 AS cagr, max(sessions) AS sessions, max(log_growth) FILTER (scenario = 'base') AS top, coalesce(sum(log_growth) FILTER (scenario = 'base' AND log_growth > 0), 0) AS pos FROM cube WHERE slice = 'full' GROUP BY strategy),
gt_p AS (SELECT strategy, count(*) FILTER (g >= 0) AS n FROM (SELECT strategy, slice, scenario, avg(log_growth) AS g FROM cube WHERE slice <> 'full' AND scenario IN ('base', 'double') GROUP BY ALL) GROUP BY strategy),
gt_x AS (SELECT m.*, n, b.sharpe AS bs, b.max_drawdown AS bd, m.sharpe - 1.645 * sqrt((1 + m.sharpe * m.sharpe / 2 / 252) * 252 / m.sessions) AS lower FROM gt_m m JOIN gt_p p ON p.strategy = m.strategy, (SELECT * FROM gt_m WHERE strategy = 'buy_and_hold') b),
gt_y AS (SELECT *, coalesce(cagr > {CASH}, false) AS g1, coalesce(sharpe >= 0.4 AND sharpe > bs, false) AS g2, coalesce(max_drawdown <= 0.2 AND max_drawdown < bd, false) AS g3, coalesce(dbl > 0, false) AS g4, n >= 3 AS g5, pos > 0 AND top / pos <= 0.4 AS g6 FROM gt_x)
SELECT strategy, {sql.all_settled('cagr sharpe max_drawdown')}, g1 AS gate_cash, g2 AS gate_sharpe, g3 AS gate_drawdown, g4 AS gate_costs, g5 AS gate_parts, g6 AS gate_spread, g1 AND g2 AND g3 AND g4 AND g5 AND g6 AS passed, {sql.settled('lower', 'lower')},
       CASE WHEN sharpe IS NULL THEN 'INSUFFICIENT' WHEN NOT (g1 AND g2 AND g3 AND g4 AND g5 AND g6) THEN 'NO EDGE' WHEN lower > 0 THEN 'EDGE' ELSE 'INSUFFICIENT' END AS verdict FROM gt_y"""


def stat_03_pairs(spark, sf_dir):
    """Differences of all pairs of strategies in three slices, resampled at the same positions, 2,000 times."""
    e = equity(spark, sf_dir).select("symbol", "strategy", "ts", "daily_return")
    part = F.when(F.col("ts") < F.lit(MIDDLE).cast("timestamp_ntz"), "early").otherwise("late")
    sliced = e.withColumn("slice", F.explode(F.array(F.lit("full"), part)))
    return statistics.paired_bootstrap(sliced, "symbol", "slice", subject="strategy")


def stat_08_status(spark, sf_dir):
    """Status of the declared tests (each timing strategy against holding, Sharpe ratio and growth, in the full slice), and what a symbol's tests conclude."""
    e = equity(spark, sf_dir).select("symbol", "strategy", "ts", "daily_return")
    timing = tuple(s.name for s in strategies.BASELINES if s.name != "buy_and_hold")
    found = statistics.paired_bootstrap(e, "symbol", subject="strategy", pairs=tuple((t, "buy_and_hold") for t in timing), metrics=("sharpe", "cumulative_log")).where("second is not null")
    tests = validation.formal_status(statistics.adjust(found.withColumn("p", F.col("p_value")).withColumn("name", F.concat_ws(":", "first", "metric")), "symbol"))
    ends = validation.conclusion(tests, "buy_and_hold", timing, "symbol")
    return tests.join(ends, "symbol").select("symbol", "first", "second", "metric", "estimate", "p", "p_holm", "p_bh", "family_size", "status", "edge", "better")


def ml_09_auc(spark, sf_dir):
    """Areas with intervals of a linear score of the features, a symbol and period."""
    from tidemark.plans.tree_queries import CENTER, SCALE, WEIGHTS

    rows = features.assemble(item_bars(spark, sf_dir)).withColumn("p", F.round(trees.linear(WEIGHTS, 0.1, CENTER, SCALE), 1))
    return validation.auc_interval(rows.select("symbol", "period", "ts", F.col("target").alias("y"), "p"), "symbol", "period")


def _timing(spark, sf_dir):
    b = _bars(spark, sf_dir)
    placed = b.select("symbol", "ts", (F.row_number().over(by()) - 1).cast("long").alias("i"), F.try_divide(F.col("open") - F.col("close"), F.col("atr")).alias("fall"))
    sides = [labels.barrier_labels(b, d, RULES).withColumn("dir", F.lit(d)) for d in (-1, 1)]
    outcomes = sides[0].unionByName(sides[1]).join(placed, ["symbol", "ts"]).select("symbol", "i", "dir", F.col("bars").cast("long").alias("bars"), "net_r")
    return validation.random_timing(outcomes, placed.where("fall > 2.5").select("symbol", "i", F.lit(-1).alias("dir")))


def stat_11_random_timing(spark, sf_dir):
    """Sales after a fall of 2.5 ATR against as many at random bars, in random directions."""
    return rounded(validation.timing_p(_timing(spark, sf_dir)))


def _outcomes(d: int) -> str:
    """CTEs o<d>: outcomes of positions in one direction."""
    n = "s" if d < 0 else "l"
    enter, leave = (0.9999, 1.0001) if d < 0 else (1.0001, 0.9999)
    worst, best = ("high", "low") if d < 0 else ("low", "high")
    beyond = lambda x, y: f"{x} >= {y}" if d < 0 else f"{x} <= {y}"
    within = lambda x, y: f"{x} <= {y}" if d < 0 else f"{x} >= {y}"
    sign = "-" if d < 0 else "+"
    return f"""r{n} AS (SELECT b.*, greatest(2.0 * atr, {_FLOOR!r}) AS risk, lead(ts, 96) OVER ({sql.W}) AS far, lead(open) OVER ({sql.W}) * {enter} AS entry, lead(day) OVER ({sql.W}) AS day0 FROM b),
u{n} AS (SELECT *, floor(least(50.0 / risk, 5000.0)) AS units, far - ts = INTERVAL 480 MINUTE AS whole FROM r{n}), f{n} AS (SELECT *, greatest(2.0, 0.2e-4 * units * entry) AS fee FROM u{n}),
p{n} AS (SELECT v.symbol, v.i, v.entry, v.risk, v.units, v.fee, v.day0, k.i - v.i AS age, k.day, k.open * {leave} AS o, k.{worst} * {leave} AS wo, k.{best} * {leave} AS be, k.close * {leave} AS cl, entry {'+' if d < 0 else '-'} risk AS stop, entry {sign} 2.0 * risk AS goal
      FROM f{n} v JOIN b k ON k.symbol = v.symbol AND k.i BETWEEN v.i + 1 AND v.i + 96 WHERE whole AND units >= 1 AND 2 * fee / (units * risk) <= 0.45 + 1e-9),
x{n} AS (SELECT symbol, i, any_value(entry) AS entry, any_value(risk) AS risk, any_value(units) AS units, any_value(fee) AS fee, any_value(day0) AS day0, min(age) AS age, arg_min(day, age) AS day,
        arg_min(CASE WHEN {beyond('o', 'stop')} OR {within('o', 'goal')} THEN o WHEN {beyond('wo', 'stop')} THEN stop WHEN {within('be', 'goal')} THEN goal ELSE cl END, age) AS price
      FROM p{n} WHERE {beyond('wo', 'stop')} OR {within('be', 'goal')} OR age = 96 GROUP BY symbol, i),
o{n} AS (SELECT symbol, i, {d} AS dir, age, {d} * (price - entry) / risk - (fee + greatest(2.0, 0.2e-4 * units * price) + greatest(0, day - day0) * 0.5e-4 * units * entry) / (units * risk) AS net_r FROM x{n})"""


STAT_11_SQL = f"""WITH RECURSIVE {_BARS}, {_outcomes(-1)}, {_outcomes(1)},
oc AS MATERIALIZED (SELECT * FROM os UNION ALL SELECT * FROM ol), al AS MATERIALIZED (SELECT symbol, i FROM oc GROUP BY ALL HAVING count(DISTINCT dir) = 2),
sg AS (SELECT symbol, i FROM b JOIN al USING (symbol, i) WHERE (open - close) / nullif(atr, 0) > 2.5), wn AS (SELECT symbol, count(*) AS wanted FROM sg GROUP BY symbol),
h AS (SELECT rep, symbol, i, wanted, md5('11|' || rep || '|' || symbol || '|' || i) AS h FROM al JOIN wn USING (symbol), range(50) AS t(rep)),
ch AS (SELECT rep, symbol, i, CASE WHEN substr(h, 32, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN -1 ELSE 1 END AS dir FROM (SELECT *, row_number() OVER (PARTITION BY rep, symbol ORDER BY h, i) AS k FROM h) WHERE k <= wanted UNION ALL SELECT -1, symbol, i, -1 FROM sg),
op AS MATERIALIZED (SELECT rep, symbol, i, i + age AS fin, net_r FROM ch JOIN oc USING (symbol, i, dir)),
nx AS MATERIALIZED (SELECT a.rep, a.symbol, a.i, a.net_r, b2.i AS nxt, row_number() OVER (PARTITION BY a.rep, a.symbol ORDER BY a.i) AS place FROM op a ASOF LEFT JOIN op b2 ON a.rep = b2.rep AND a.symbol = b2.symbol AND a.fin <= b2.i),
tk AS (SELECT rep, symbol, i, net_r, nxt FROM nx WHERE place = 1 UNION ALL SELECT n.rep, n.symbol, n.i, n.net_r, n.nxt FROM tk JOIN nx n ON n.rep = tk.rep AND n.symbol = tk.symbol AND n.i = tk.nxt),
mn AS (SELECT rep, avg(net_r) AS mean, count(*) AS trades FROM tk GROUP BY rep), re AS (SELECT mean AS m0, trades AS t0 FROM mn WHERE rep < 0)
SELECT max(t0) AS trades, {sql.settled('max(m0)', 'mean')}, {sql.settled('avg(mean)', 'random_mean')}, {sql.settled('max(mean)', 'random_max')}, count(*) AS reps, {sql.settled('(1 + count(*) FILTER (mean >= m0))::DOUBLE / (count(*) + 1)', 'p')} FROM mn, re WHERE rep >= 0"""

QUERIES = {f.__name__: f for f in (stat_04_scenarios, stat_13_gates, stat_03_pairs, stat_08_status, ml_09_auc, stat_11_random_timing)}
SQL = {"stat_04_scenarios": STAT_04_SQL, "stat_13_gates": STAT_13_SQL, "stat_11_random_timing": STAT_11_SQL}
