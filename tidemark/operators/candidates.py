"""Candidates that trade on paper, and the cash that their fills leave: when one is retired, who follows, and whether the books agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A candidate retires at so many R below its realised peak, or after so many closed trades with a negative mean and more lost than won in the last ones (fixed values).
DRAWDOWN, CLOSED, RECENT = 5.0, 20, 50
#: How far cash may differ in the smallest usual unit of a currency (fixed values), and in others.
TOLERANCE, USUAL = {"JPY": 0.5}, 0.005


def retirement(trades: DataFrame, ranking: DataFrame) -> DataFrame:
    """One row for each candidate of trades (candidate, ts, net_r): closed, net_r, drawdown_r (below the highest sum so far, 0 included), recent_mean, profit_factor (null without losses), retire, reason and replacement: of
    ranking (candidate, place, eligible, active) the first by place that is eligible and neither active nor retired. Without one nobody follows. Trades at one time go by their result."""
    w = Window.partitionBy("candidate").orderBy("ts", "net_r")
    last = F.row_number().over(Window.partitionBy("candidate").orderBy(F.desc("ts"), F.desc("net_r")))
    placed = trades.select("candidate", "ts", "net_r", F.sum("net_r").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("__sum"), last.alias("__last"))
    recent = F.when(F.col("__last") <= RECENT, F.col("net_r"))
    won, lost = F.sum(F.greatest(recent, F.lit(0.0)) + 0 * recent), -F.sum(F.least(recent, F.lit(0.0)) + 0 * recent)
    seen = placed.groupBy("candidate").agg(F.count("*").alias("closed"), F.sum("net_r").alias("net_r"), F.greatest(F.lit(0.0), F.max("__sum")).alias("__peak"), F.max(F.when(F.col("__last") == 1, F.col("__sum"))).alias("__now"), F.avg(recent).alias("recent_mean"), won.alias("__won"), lost.alias("__lost"))
    fell = F.col("drawdown_r") >= DRAWDOWN
    weak = (F.col("closed") >= CLOSED) & (F.col("recent_mean") < 0) & (F.col("__lost") > F.col("__won"))
    out = seen.withColumn("drawdown_r", F.col("__peak") - F.col("__now")).withColumns({"profit_factor": F.when(F.col("__lost") > 0, F.col("__won") / F.col("__lost")), "retire": fell | weak, "reason": F.when(fell, "drawdown").when(weak, "weak").otherwise("continue")})
    gone = out.where("retire").select("candidate")
    free = ranking.where("eligible and not active").join(gone, "candidate", "left_anti").agg(F.min_by("candidate", "place").alias("__next"))  # one row
    return out.join(F.broadcast(free)).select("candidate", "closed", "net_r", "drawdown_r", "recent_mean", "profit_factor", "retire", "reason", F.when(F.col("retire"), F.col("__next")).alias("replacement"))


def cash_legs(fills: DataFrame) -> DataFrame:
    """ccy and amount of what each execution (exec_id, base, quote, units signed, price, fee, fee_ccy) moves. An execution that is reported again with the same values moves nothing more."""
    legs = F.array(F.struct(F.col("base").alias("ccy"), F.col("units").alias("amount")), F.struct(F.col("quote").alias("ccy"), (-F.col("units") * F.col("price")).alias("amount")), F.struct(F.col("fee_ccy").alias("ccy"), (-F.col("fee")).alias("amount")))
    return fills.dropDuplicates(["exec_id", "base", "quote", "units", "price", "fee", "fee_ccy"]).select("exec_id", F.explode(legs).alias("l")).select("exec_id", "l.*")


def reconciled(fills: DataFrame, opening: DataFrame, actual: DataFrame) -> DataFrame:
    """ccy, expected (opening and all legs), actual, difference, corrections (executions that came with differing values and touch the currency) and agrees: within the tolerance and without corrections. A currency that
    either side lacks counts as 0 there."""
    legs = cash_legs(fills)
    corrected = fills.dropDuplicates(["exec_id", "base", "quote", "units", "price", "fee", "fee_ccy"]).groupBy("exec_id").count().where("count > 1").select("exec_id")
    moved = legs.groupBy("ccy").agg(F.sum("amount").alias("__moved"))
    doubtful = legs.join(corrected, "exec_id").groupBy("ccy").agg(F.count_distinct("exec_id").alias("corrections"))
    both = opening.select("ccy", F.col("amount").alias("__opening")).join(moved, "ccy", "full_outer").join(actual.select("ccy", F.col("amount").alias("actual")), "ccy", "full_outer").join(doubtful, "ccy", "left")
    none = lambda c: F.coalesce(c, F.lit(0.0))
    out = both.withColumns({"expected": none(F.col("__opening")) + none(F.col("__moved")), "actual": none(F.col("actual")), "corrections": F.coalesce("corrections", F.lit(0))}).withColumn("difference", F.col("actual") - F.col("expected"))
    return out.select("ccy", "expected", "actual", "difference", "corrections", ((F.abs("difference") <= tolerance(F.col("ccy"))) & (F.col("corrections") == 0)).alias("agrees"))


def tolerance(ccy: Column) -> Column:
    out = F.lit(USUAL)
    for name, value in TOLERANCE.items():
        out = F.when(ccy == name, value).otherwise(out)
    return out
