"""Cash rates, costs, calendars and summaries of an allocation over days: ACT/360 interest, years of 365.25 days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.functions.semantics import asof, by, full, lagged, rolling_mean, trailing, with_runs

#: Limits and factors (fixed values).
DRIFT, STALE_LIMIT, VIABLE_PCT, WARM_UP = 0.25, 5, 0.5, 200
SCENARIOS = (("zero", 0.0), ("realistic", 1.0), ("double", 2.0))


def known_rates(days: DataFrame, rates: DataFrame, *keys: str) -> DataFrame:
    """days(keys, ts) with the rate dated at or before the day before, and the calendar days since then. Null on the first day and
    where no rate is known yet."""
    at = asof(days.select(*keys, "ts"), rates.select(*keys, "ts", "rate"), "rate", *keys)
    return at.select(*keys, "ts", F.lag("rate").over(by(*keys)).alias("rate"), F.datediff("ts", F.lag("ts").over(by(*keys))).alias("gap"))


def cash_returns(days: DataFrame, rates: DataFrame, *keys: str) -> DataFrame:
    known = known_rates(days, rates, *keys)
    return known.select(*keys, "ts", (F.col("rate") * F.col("gap") / 360).alias("cash_return"))


def rate_audit(days: DataFrame, rates: DataFrame, *keys: str, limit: int = STALE_LIMIT) -> DataFrame:
    """Coverage of each rate series, and how stale it is on the days that need it, in weekdays."""
    gap = calendar.weekdays_between(F.lag("ts").over(by(*keys)), F.col("ts"))
    series = rates.withColumn("gap", gap).groupBy(*keys).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("observations"), F.count_if(F.col("rate") <= 0).alias("non_positive"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap")
    )
    known = asof(days.select(*keys, "ts"), rates.select(*keys, "ts", F.col("ts").alias("dated")), "dated", *keys)
    stale = known.withColumn("stale", calendar.weekdays_between(F.col("dated"), F.col("ts"))).groupBy(*keys).agg(
        F.count("*").alias("checked"), F.count_if(F.col("dated").isNull()).alias("without_rate"), F.coalesce(F.max("stale"), F.lit(-1)).alias("max_stale"), F.count_if(F.col("stale") > limit).alias("over_limit")
    )
    return series.join(stale, list(keys))


def evaluable_start(bars: DataFrame, warm_up: int = WARM_UP) -> DataFrame:
    """The last symbol to finish its warm-up, when, and the first session of any symbol from then on. No row without bars."""
    ready = bars.withColumn("n", F.row_number().over(by())).where(F.col("n") == warm_up).agg(F.max_by("symbol", F.struct("ts", "symbol")).alias("binding"), F.max("ts").alias("ready"))
    return bars.select("ts").crossJoin(ready).where(F.col("ts") >= F.col("ready")).groupBy("binding", "ready").agg(F.min("ts").alias("start"))


def summary(daily: DataFrame, *keys: str, capital: float) -> DataFrame:
    """One row a run of daily (keys, ts, nav, cash_return, exposure, traded, cost): growth against cash, Sharpe of the excess over
    cash at the run's own sessions a year, worst month, turnover, exposure and costs. Ratios without dispersion are null."""
    w = by(*keys)
    d = daily.withColumn("r", F.try_divide("nav", F.lag("nav").over(w)) - 1).withColumn("excess", F.col("r") - F.col("cash_return"))
    months = d.where(F.col("r").isNotNull()).groupBy(*keys, F.date_trunc("month", "ts").alias("m")).agg((F.exp(F.sum(F.ln(F.col("r") + 1))) - 1).alias("m_return")).groupBy(*keys).agg(F.min("m_return").alias("worst_month"))
    years = F.datediff(F.max("ts"), F.min("ts")) / 365.25
    runs = d.groupBy(*keys).agg(
        F.count("*").alias("sessions"), years.alias("years"), ((F.count("*") - 1) / years).alias("per_year"), (F.max_by("nav", "ts") / capital).alias("growth"), F.sum(F.ln(F.col("cash_return") + 1)).alias("cash_growth"),
        F.stddev_samp("r").alias("sd"), F.avg("excess").alias("mean"), F.stddev_samp("excess").alias("excess_sd"), F.avg("nav").alias("average_nav"), F.sum("traded").alias("traded"), F.sum("cost").alias("cost"), F.avg("exposure").alias("average_exposure"),
    )
    root = F.sqrt("per_year")
    return runs.join(months, list(keys), "left").select(
        *keys, "sessions", "years", F.ln("growth").alias("log_growth"), (F.pow("growth", 1 / F.col("years")) - 1).alias("cagr"), (F.exp(F.col("cash_growth") / F.col("years")) - 1).alias("cash_cagr"),
        (F.col("sd") * root).alias("volatility"), (F.try_divide(F.col("mean"), F.col("excess_sd")) * root).alias("sharpe"), "worst_month",
        (F.col("traded") / F.col("average_nav") / F.col("years")).alias("turnover"), "average_exposure", (100 * F.col("cost") / F.col("average_nav") / F.col("years")).alias("cost_pct"),
    )


def ter_drag(daily: DataFrame, ter_pct: Column, *keys: str) -> DataFrame:
    """Yearly charge inside prices as a percentage of the average value: each day's holding pays until the next day."""
    held = daily.withColumn("charge", F.col("nav") * F.col("exposure") * ter_pct / 100 * F.datediff(F.lead("ts").over(by(*keys)), "ts") / 365)
    years = F.datediff(F.max("ts"), F.min("ts")) / 365.25
    return held.groupBy(*keys).agg((100 * F.sum("charge") / F.avg("nav") / years).alias("ter_drag"))


def viable_capital(runs: DataFrame, capitals: Sequence[int], *keys: str, least: float = 3.0, rate: float = 0.0005, side: float = 0.0006, limit: float = VIABLE_PCT) -> DataFrame:
    """Pooled yearly cost of runs(keys, trades, years) for each capital, and whether it is the smallest below the limit. A trade
    turns the capital over at max(least, rate) plus a side's spread and slippage."""
    each = runs.select(*keys, "trades", "years", F.explode(F.array(*[F.lit(c).cast("long") for c in capitals])).alias("capital"))
    cost = F.col("trades") * (F.greatest(F.lit(least), rate * F.col("capital")) + side * F.col("capital"))
    table = each.groupBy(*keys, "capital").agg((100 * F.sum(cost) / F.sum(F.col("capital") * F.col("years"))).alias("cost_pct"))
    first = F.min(F.when(F.col("cost_pct") < limit, F.col("capital"))).over(Window.partitionBy(*keys))
    return table.withColumn("reference", F.coalesce(F.col("capital") == first, F.lit(False)))


def ter_adjustment(kind: Column, eu: Column, proxy: Column, scenario: Column) -> Column:
    """Yearly adjustment in percent of a series' return: a product's own prices hold its charge, a proxy's hold the proxy's, an
    index holds none; the scenario charges nothing, the charge or twice the charge."""
    factor = F.when(scenario == "zero", 0.0).when(scenario == "realistic", 1.0).when(scenario == "double", 2.0)
    inside = F.when(kind == "product_own", eu).when(kind == "proxy", proxy).when(kind == "index", 0.0)
    return inside - factor * eu


def needs_trade(state: Column, before: Column, actual: Column, target: Column, threshold: float = DRIFT) -> Column:
    """A change between LONG and CASH, or a LONG weight that drifted by more than the threshold; without data never."""
    known = lambda s: F.coalesce(s.isin("LONG", "CASH"), F.lit(False))
    drifted = (state == "LONG") & (F.try_divide(F.abs(actual - target), target) > threshold)
    return known(state) & ((known(before) & (state != before)) | F.coalesce(drifted, F.lit(False)))


def signal_table(bars: DataFrame, window: int = WARM_UP, vol: int = 60, still: int = 5) -> DataFrame:
    """state against the long average, volatility of log returns a year, and whether more than `still` unchanged closes in a row
    lie within the volatility's window."""
    b = bars.withColumns({"sma": rolling_mean("close", window), "r": F.ln(F.col("close") / lagged("close"))})
    b = with_runs(b.withColumn("still", F.coalesce(F.col("r") == 0, F.lit(False))), "still").withColumn("streak", F.when(F.col("still"), F.col("run_age")).otherwise(0))
    state = F.when(F.col("sma").isNull(), "INSUFFICIENT_DATA").when(F.col("close") > F.col("sma"), "LONG").otherwise("CASH")
    return b.select("symbol", "ts", state.alias("state"), (full(F.stddev_samp("r"), F.col("r"), trailing(vol), vol) * 252**0.5).alias("vol"), (F.max("streak").over(trailing(vol)) > still).alias("stale"))


def on_calendar(table: DataFrame, days: DataFrame, assets: Sequence[str], value: str) -> DataFrame:
    """The latest own row's value of each of the listed assets on every day of the calendar."""
    grid = days.select("ts").distinct().withColumn("symbol", F.explode(F.array(*[F.lit(a) for a in assets])))
    return asof(grid, table.select("symbol", "ts", value), value, "symbol")


def warm_up_slice(bars: DataFrame, start: str, rows: int = WARM_UP + 1) -> DataFrame:
    """From `rows` bars back of each symbol's last session at or before the start, that session included, to the end."""
    at = F.lit(start).cast("timestamp_ntz")
    ref = F.max(F.when(F.col("ts") <= at, F.col("ts"))).over(Window.partitionBy("symbol"))
    b = bars.withColumns({"n": F.row_number().over(by()), "ref": ref})
    pos = F.max(F.when(F.col("ts") == F.col("ref"), F.col("n"))).over(Window.partitionBy("symbol"))
    return b.withColumn("pos", pos).where(F.col("n") > F.col("pos") - rows).drop("n", "pos")


def anchors(products: DataFrame, levels: DataFrame, start: str) -> DataFrame:
    """Units of a product for one of its index's level: the first close at or after the start over the level known that day."""
    first = products.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz")).groupBy("symbol").agg(F.min("ts").alias("ts"), F.min_by("close", "ts").alias("close"))
    return asof(first, levels.select("symbol", "ts", "level"), "level", "symbol").withColumn("anchor", F.try_divide("close", "level"))


def total_return_factor(close: str = "close", dividend: str = "dividend") -> Column:
    """What a holding of the close before is worth with the day's dividend; null on the first bar."""
    return F.try_divide(F.col(close) + F.coalesce(F.col(dividend), F.lit(0.0)), F.lag(close).over(by()))
