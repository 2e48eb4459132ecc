"""Queries of paper candidates and cash."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import rounded
from tidemark.operators import candidates
from tidemark.plans import price_queries as price
from tidemark.plans import sql
from tidemark.plans.rule_queries import PAIRS
from tidemark.sources.bars import table


def sim_44_retirement(spark, sf_dir):
    """Candidates are a signal set on a symbol, with their trades; breakouts are active, the others may follow, by what they have brought."""
    trades = price.sim_29_bracket_trades(spark, sf_dir).select(F.concat_ws("|", "symbol", "strategy").alias("candidate"), F.col("entry_ts").alias("ts"), F.col("r_net").alias("net_r"))
    total = trades.groupBy("candidate").agg(F.round(F.sum("net_r"), 6).alias("total"), F.count("*").alias("n"))
    ranking = total.select("candidate", F.row_number().over(Window.orderBy(F.desc("total"), "candidate")).alias("place"), (F.col("n") >= 3).alias("eligible"), F.col("candidate").endswith("breakout").alias("active"))
    return rounded(candidates.retirement(trades, ranking))


SIM_44_SQL = f"""WITH t AS (SELECT symbol || '|' || strategy AS candidate, entry_ts AS ts, r_net AS net_r FROM ({price.SIM_29_SQL})),
p AS (SELECT *, sum(net_r) OVER (PARTITION BY candidate ORDER BY ts, net_r ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY candidate ORDER BY ts DESC, net_r DESC) AS k FROM t),
c AS (SELECT candidate, count(*) AS closed, sum(net_r) AS net_r, greatest(0.0, max(s)) - max(s) FILTER (k = 1) AS drawdown_r, avg(net_r) FILTER (k <= 50) AS recent_mean, coalesce(sum(net_r) FILTER (k <= 50 AND net_r > 0), 0) AS won, coalesce(-sum(net_r) FILTER (k <= 50 AND net_r < 0), 0) AS lost FROM p GROUP BY candidate),
d AS (SELECT *, drawdown_r >= 5 AS fell, closed >= 20 AND recent_mean < 0 AND lost > won AS weak FROM c),
n AS (SELECT arg_min(candidate, place) AS nxt FROM (SELECT candidate, row_number() OVER (ORDER BY round(sum(net_r), 6) DESC, candidate) AS place, count(*) >= 3 AS ok FROM t GROUP BY candidate) WHERE ok AND NOT ends_with(candidate, 'breakout') AND candidate NOT IN (SELECT candidate FROM d WHERE fell OR weak))
SELECT candidate, closed, {sql.all_settled('net_r drawdown_r recent_mean')}, {sql.settled('CASE WHEN lost > 0 THEN won / lost END', 'profit_factor')}, fell OR weak AS retire, CASE WHEN fell THEN 'drawdown' WHEN weak THEN 'weak' ELSE 'continue' END AS reason, CASE WHEN fell OR weak THEN nxt END AS replacement FROM d, n"""


def sim_45_cash(spark, sf_dir):
    """Events as executions of their pair: bought above 50, else sold; every fiftieth is reported twice, every 211th corrected. The statement rounds each leg to hundredths."""
    names = spark.createDataFrame([(k, *v) for k, v in PAIRS.items()], "event_type string, base string, quote string")
    e = table(spark, sf_dir, "events").join(F.broadcast(names), "event_type")
    f = e.select(F.col("event_id").alias("exec_id"), "base", "quote", F.when(F.col("value") > 50, 1000.0).otherwise(-1000.0).alias("units"), (F.col("value") / 7).alias("price"), F.lit(2.0).alias("fee"), F.lit("USD").alias("fee_ccy"))
    again = f.where("exec_id % 50 = 0").unionByName(f.where("exec_id % 211 = 0 and base <> 'GBP'").withColumn("price", F.col("price") + 0.001))
    opening = spark.createDataFrame([("EUR", 10_000.0), ("CHF", 5.0), ("SEK", 1.0)], "ccy string, amount double")
    told = candidates.cash_legs(f.unionByName(again)).groupBy("ccy").agg(F.sum(F.round("amount", 2)).alias("amount"))
    told = told.unionByName(opening).groupBy("ccy").agg(F.sum("amount").alias("amount"))
    return rounded(candidates.reconciled(f.unionByName(again), opening, told), 4)


SIM_45_SQL = f"""WITH pr(event_type, base, quote) AS (VALUES {", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in PAIRS.items())}), op(ccy, amount) AS (VALUES ('EUR', 10000.0::DOUBLE), ('CHF', 5.0), ('SEK', 1.0)),
f AS (SELECT event_id, base, quote, CASE WHEN value > 50 THEN 1000.0 ELSE -1000.0 END::DOUBLE AS units, value / 7 AS price FROM events JOIN pr USING (event_type)), g AS (SELECT * FROM f UNION ALL SELECT event_id, base, quote, units, price + 0.001 FROM f WHERE event_id % 211 = 0 AND base <> 'GBP'),
l AS (SELECT event_id, base AS ccy, units AS amount FROM g UNION ALL SELECT event_id, quote, -units * price FROM g UNION ALL SELECT event_id, 'USD', -2.0 FROM g),
m AS (SELECT ccy, sum(amount) AS moved, sum(round(amount, 2)) AS told, count(DISTINCT event_id) FILTER (event_id % 211 = 0 AND event_id IN (SELECT event_id FROM f WHERE base <> 'GBP')) AS corrections FROM l GROUP BY ccy),
x AS (SELECT coalesce(m.ccy, op.ccy) AS ccy, coalesce(moved, 0) + coalesce(op.amount, 0) AS expected, coalesce(told, 0) + coalesce(op.amount, 0) AS actual, coalesce(corrections, 0) AS corrections FROM m FULL JOIN op ON op.ccy = m.ccy)
SELECT ccy, {sql.settled('expected', 'expected', 4)}, {sql.settled('actual', 'actual', 4)}, {sql.settled('actual - expected', 'difference', 4)}, corrections, abs(actual - expected) <= CASE WHEN ccy = 'JPY' THEN 0.5 ELSE 0.005 END AND corrections = 0 AS agrees FROM x"""

QUERIES = {f.__name__: f for f in (sim_44_retirement, sim_45_cash)}
SQL = dict(zip(QUERIES, (SIM_44_SQL, SIM_45_SQL), strict=True))
