"""Queries of positions and their cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.semantics import rounded
from tidemark.operators import books
from tidemark.plans import sql
from tidemark.sources.bars import table

ORDER = ("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


def sim_33_netting(spark, sf_dir):
    """A book for each supplier: open lines buy, the others sell, on their ship dates at what a unit costs; tax is a commission in hundredths of a unit's price,
    discount a part of the conversion into the account's currency."""
    lines = table(spark, sf_dir, "lineitem").withColumns({
        "ts": F.col("l_shipdate").cast("timestamp_ntz"), "units": F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(-F.col("l_quantity")),
        "price": F.col("l_extendedprice") / F.col("l_quantity"), "commission": F.col("l_tax") * F.col("l_extendedprice") / 100, "rate": 1 - F.col("l_discount"),
    })
    book = books.netting_book(lines.select("l_suppkey", *ORDER, "units", "price", "commission", "rate"), "l_suppkey", order=ORDER, rate="rate")
    return rounded(book.select("l_suppkey", "ts", "l_orderkey", "l_linenumber", "l_partkey", "units", "action", "units_before", "units_after", "avg_price", "realized", "cash"), 4)


_PLACE = "PARTITION BY l_suppkey ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"
SIM_33_SQL = f"""WITH RECURSIVE l0 AS (SELECT *, l_shipdate AS ts, CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE -l_quantity END AS units, l_extendedprice / l_quantity AS price, l_tax * l_extendedprice / 100 AS fee, 1 - l_discount AS rate FROM lineitem),
l AS MATERIALIZED (SELECT l_suppkey, ts, l_orderkey, l_linenumber, l_partkey, units, price, fee, rate, row_number() OVER ({_PLACE}) AS i FROM l0),
b AS (SELECT l_suppkey, i, 0.0::DOUBLE AS was, units AS now, price AS avg_price, 0.0::DOUBLE AS gain, 'OPEN' AS action FROM l WHERE i = 1
  UNION ALL SELECT l.l_suppkey, l.i, b.now, round(b.now + l.units, 9),
    CASE WHEN b.now = 0 THEN l.price WHEN b.now * l.units > 0 THEN (b.avg_price * b.now + l.price * l.units) / (b.now + l.units) WHEN round(b.now + l.units, 9) = 0 THEN NULL WHEN abs(l.units) < abs(b.now) THEN b.avg_price ELSE l.price END,
    CASE WHEN b.now * l.units < 0 THEN least(abs(l.units), abs(b.now)) * (l.price - b.avg_price) * sign(b.now) * l.rate ELSE 0 END,
    CASE WHEN b.now = 0 THEN 'OPEN' WHEN b.now * l.units > 0 THEN 'INCREASE' WHEN round(b.now + l.units, 9) = 0 THEN 'CLOSE' WHEN abs(l.units) < abs(b.now) THEN 'REDUCE' ELSE 'REVERSE' END
  FROM b JOIN l ON l.l_suppkey = b.l_suppkey AND l.i = b.i + 1)
SELECT l.l_suppkey, ts, l_orderkey, l_linenumber, l_partkey, {sql.settled('units', 'units', 4)}, action, {sql.settled('was', 'units_before', 4)}, {sql.settled('now', 'units_after', 4)}, {sql.settled('avg_price', 'avg_price', 4)},
       {sql.settled('gain', 'realized', 4)}, {sql.settled('gain - fee', 'cash', 4)} FROM b JOIN l ON l.l_suppkey = b.l_suppkey AND l.i = b.i"""


def sim_25_average_cost(spark, sf_dir):
    """A book for each supplier: each line is bought on its ship date; five times its discount of it is sold 30 days later and the rest after 90 days, each a per cent dearer;
    costs are its tax on what is traded."""
    line = table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    share = F.round(F.col("l_discount") * 5, 2)
    leg = lambda number, days, side, part, up: F.struct(F.lit(number).alias("leg"), (F.col("l_shipdate").cast("timestamp_ntz") + F.expr(f"interval {days} days")).alias("ts"), F.lit(side).alias("side"), F.round(F.col("l_quantity") * part, 4).alias("shares"), (F.col("price") * up).alias("fill"))
    legs = F.explode(F.array(leg(0, 0, "BUY", F.lit(1.0), 1.0), leg(1, 30, "SELL", share, 1.01), leg(2, 90, "SELL", 1 - share, 1.0201)))
    key = ("ts", "leg", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    f = line.withColumn("x", legs).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax", "x.*").where("shares > 0")
    f = f.withColumn("notional", F.col("shares") * F.col("fill")).withColumn("costs", F.col("notional") * F.col("l_tax")).drop("fill", "l_tax")
    out = books.average_cost(f, "l_suppkey", order=key)
    return rounded(out.select("l_suppkey", "ts", "leg", "l_orderkey", "l_linenumber", "l_partkey", "side", "action", "shares_after", "basis_notional", "basis_costs", "realized"), 3)


SIM_25_SQL = f"""WITH RECURSIVE d AS (SELECT *, l_extendedprice / l_quantity AS price, round(l_discount * 5, 2) AS share FROM lineitem),
g AS (SELECT *, l_shipdate AS ts, 0 AS leg, 'BUY' AS side, l_quantity AS shares, price AS fill FROM d UNION ALL SELECT *, l_shipdate + INTERVAL 30 DAY, 1, 'SELL', round(l_quantity * share, 4), price * 1.01 FROM d UNION ALL SELECT *, l_shipdate + INTERVAL 90 DAY, 2, 'SELL', round(l_quantity * (1 - share), 4), price * 1.0201 FROM d),
l AS MATERIALIZED (SELECT l_suppkey, ts, leg, l_orderkey, l_linenumber, l_partkey, side, shares, shares * fill AS notional, shares * fill * l_tax AS costs, row_number() OVER (PARTITION BY l_suppkey ORDER BY ts, leg, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS i FROM g WHERE shares > 0),
b AS (SELECT l_suppkey, i, shares AS held, notional AS bn, costs AS bc, 0.0::DOUBLE AS gain, 'ENTRY' AS action FROM l WHERE i = 1
  UNION ALL SELECT l.l_suppkey, l.i, round(CASE WHEN side = 'BUY' THEN held + shares ELSE held - shares END, 9),
    CASE WHEN side = 'BUY' THEN (CASE WHEN held = 0 THEN 0 ELSE bn END) + notional WHEN round(held - shares, 9) = 0 THEN 0 ELSE bn * (held - shares) / held END, CASE WHEN side = 'BUY' THEN (CASE WHEN held = 0 THEN 0 ELSE bc END) + costs WHEN round(held - shares, 9) = 0 THEN 0 ELSE bc * (held - shares) / held END,
    CASE WHEN side = 'BUY' THEN 0 ELSE notional - costs - (bn + bc) * least(1.0, shares / held) END, CASE WHEN side = 'BUY' THEN CASE WHEN held = 0 THEN 'ENTRY' ELSE 'ADD' END WHEN round(held - shares, 9) = 0 THEN 'EXIT' ELSE 'REDUCE' END
  FROM b JOIN l ON l.l_suppkey = b.l_suppkey AND l.i = b.i + 1)
SELECT l.l_suppkey, ts, leg, l_orderkey, l_linenumber, l_partkey, side, action, {sql.settled('held', 'shares_after', 3)}, {sql.settled('bn', 'basis_notional', 3)}, {sql.settled('bc', 'basis_costs', 3)}, {sql.settled('gain', 'realized', 3)} FROM b JOIN l ON l.l_suppkey = b.l_suppkey AND l.i = b.i"""

QUERIES = {f.__name__: f for f in (sim_33_netting, sim_25_average_cost)}
SQL = dict(zip(QUERIES, (SIM_33_SQL, SIM_25_SQL), strict=True))
