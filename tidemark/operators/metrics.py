"""Returns, drawdowns and performance metrics of equity series, grouped by any keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import by, running

YEAR = 252


def with_returns(equity: DataFrame, *keys: str, initial: float = 100_000.0) -> DataFrame:
    """Adds daily_return (the first against the initial capital; null after an equity of 0), running_peak and drawdown."""
    before = F.coalesce(F.lag("equity").over(by(*keys)), F.lit(initial))
    peak = F.greatest(F.max("equity").over(running(*keys)), F.lit(initial))
    return equity.withColumns({"daily_return": F.try_divide(F.col("equity"), before) - 1, "running_peak": peak, "drawdown": F.col("equity") / peak - 1})


def longest_run(df: DataFrame, flag: Column, *keys: str, into: str = "longest") -> DataFrame:
    """Longest stretch of consecutive rows where flag holds, 0 if none, for each key."""
    numbered = df.select(*keys, "ts", flag.alias("__f"), F.row_number().over(by(*keys)).alias("__i"))
    islands = numbered.withColumn("__g", F.col("__i") - F.row_number().over(Window.partitionBy(*keys, "__f").orderBy("ts")))
    lengths = islands.groupBy(*keys, "__f", "__g").agg(F.count("*").alias("__n"))
    return lengths.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("__f"), F.col("__n"))), F.lit(0)).cast("long").alias(into))


def return_metrics(series: DataFrame, *keys: str, initial: float = 100_000.0, year: int = YEAR) -> DataFrame:
    """One row a key of with_returns() rows: sessions, cumulative, CAGR, volatility, Sharpe, Sortino, worst drawdown and its length.
    Ratios without enough rows or without dispersion are null; so are all return ratios where a return is undefined."""
    r, n = F.col("daily_return"), F.count("*")
    lost = F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2)))
    known = F.count_if(r.isNull()) == 0
    final = F.max_by("equity", "ts")
    out = series.groupBy(*keys).agg(
        n.alias("sessions"), final.alias("final_equity"), (final / initial - 1).alias("cumulative_return"),
        F.when(final > 0, F.pow(final / initial, year / n) - 1).alias("cagr"),
        F.when(known & (n >= 2), F.stddev_samp(r) * year**0.5).alias("annualized_volatility"),
        F.when(known & (n >= 2) & (F.stddev_samp(r) > 0), F.avg(r) / F.stddev_samp(r) * year**0.5).alias("sharpe"),
        F.when(known & (n >= 2) & (lost > 0), F.avg(r) / lost * year**0.5).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"), F.count_if(r.isNull()).alias("undefined_returns"),
    )
    return out.join(longest_run(series, F.col("drawdown") < 0, *keys, into="max_drawdown_sessions"), list(keys))


def concentration(series: DataFrame, *keys: str, best: int = 10, share: float = 0.01) -> DataFrame:
    """Log growth without the best days, and the share of log growth that the top percent of days gave."""
    ranked = series.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("daily_return"), "ts"))).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    log = F.ln(F.col("daily_return") + 1)
    top = F.col("__rank") <= F.ceil(F.col("__n") * share)
    return ranked.groupBy(*keys).agg(F.sum(F.when(F.col("__rank") > best, log)).alias("log_growth_without_best"), F.try_divide(F.sum(F.when(top, log)), F.sum(log)).alias("top_share"))


def subperiods(series: DataFrame, *keys: str, parts: int = 4) -> DataFrame:
    """Compound return of equal consecutive parts; earlier parts take the remainder."""
    tiled = series.withColumn("part", F.ntile(parts).over(by(*keys)))
    return tiled.groupBy(*keys, "part").agg(F.count("*").alias("sessions"), F.sum(F.ln(F.col("daily_return") + 1)).alias("log_growth")).withColumn("part_return", F.exp("log_growth") - 1)


def trade_metrics(trades: DataFrame, *keys: str) -> DataFrame:
    """Of closed trades (net_return, net_pnl, holding_sessions, entry_ts)."""
    won = F.col("net_pnl") > 0
    ranked = trades.withColumn("__place", F.row_number().over(Window.partitionBy(*keys, won).orderBy(F.desc("net_pnl"), "entry_ts")))
    profit = F.sum(F.when(won, F.col("net_pnl")))
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("completed_trades"), F.avg((F.col("net_return") > 0).cast("double")).alias("win_rate"), F.avg("net_return").alias("avg_trade"), F.median("net_return").alias("median_trade"),
        F.max("net_return").alias("best_trade"), F.min("net_return").alias("worst_trade"), F.avg("holding_sessions").alias("avg_holding"),
        F.try_divide(F.sum(F.when(won & (F.col("__place") <= 5), F.col("net_pnl"))), profit).alias("top5_share"),
    )


def activity_metrics(equity: DataFrame, *keys: str, year: int = YEAR) -> DataFrame:
    turnover = F.when(F.avg("equity") > 0, F.sum("traded_notional") / F.avg("equity"))
    return equity.groupBy(*keys).agg(F.avg("position").alias("exposure"), F.count_if("executed").alias("orders"), turnover.alias("turnover"), (turnover * year / F.count("*")).alias("annualized_turnover"), F.sum("costs").alias("total_costs"))
