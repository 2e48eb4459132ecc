"""Volatility, momentum, participation and composite regimes, and their transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import with_ranks, with_runs
from tidemark.operators import indicators, structure

INSUFFICIENT = "insufficient_data"
#: Reference rows, fewest of them, percentile bounds.
LOOKBACK, FEWEST = 756, 252
LOW, HIGH, EXTREME = 0.20, 0.80, 0.95


def causal_percentile(df: DataFrame, x: str, into: str, count: str, lookback: int = LOOKBACK, fewest: int = FEWEST) -> DataFrame:
    """df with the mid-rank of x among the previous lookback values, ties counting half, and how many of them are defined. The
    rank is null with fewer than fewest of them."""
    ranked = with_ranks(df, x, lookback)
    rank = F.round((F.col("__below") + 0.5 * F.col("__equal")) / F.col("__count"), 10)
    return ranked.withColumns({into: F.when(F.col("__count") >= fewest, rank), count: F.col("__count")}).drop("__below", "__equal", "__count")


def volatility(p: Column) -> Column:
    return F.when(p.isNull(), INSUFFICIENT).when(p >= EXTREME, "extreme").when(p >= HIGH, "high").when(p < LOW, "low").otherwise("normal")


def momentum(rsi: Column, roc: Column, macd: Column) -> Column:
    """All three must agree; RSI beyond 70 or 30 makes it extreme."""
    up, down = (rsi > 50) & (roc > 0) & (macd > 0), (rsi < 50) & (roc < 0) & (macd < 0)
    missing = rsi.isNull() | roc.isNull() | macd.isNull()
    return F.when(missing, INSUFFICIENT).when(up & (rsi >= 70), "extreme_positive").when(down & (rsi <= 30), "extreme_negative").when(up, "positive").when(down, "negative").otherwise("neutral")


def participation(relative_volume: Column) -> Column:
    return F.when(relative_volume.isNull(), INSUFFICIENT).when(relative_volume >= 1.5, "high").when(relative_volume < 0.5, "low").otherwise("normal")


def composite(trend: Column, vol: Column) -> Column:
    """Trend and volatility in one label; an unknown trend is an error."""
    moving = F.when(trend == "uptrend", "trending_up").when(trend == "downtrend", "trending_down").when(trend == "range", "ranging")
    between = F.when(vol == "low", "low_volatility_transition").when(vol == "normal", "transition").otherwise("high_volatility_transition")
    return F.when((trend == INSUFFICIENT) | (vol == INSUFFICIENT), INSUFFICIENT).when(moving.isNotNull(), moving).when(trend == "transition", between).otherwise(F.raise_error(F.concat(F.lit("unknown trend "), trend)))


DIMENSIONS = ("trend", "volatility", "momentum", "participation", "composite")


def analyse(bars: DataFrame) -> DataFrame:
    """Regimes of each bar with changed and age for each dimension."""
    ind = indicators.analyse(bars).withColumn("__v", F.round("realized_vol_20", 10))
    ind = causal_percentile(ind, "__v", "volatility_percentile", "volatility_reference_count")
    state = ind.join(structure.structure(bars).select("symbol", "ts", F.col("structure").alias("trend_regime"), "trend_quality"), ["symbol", "ts"])
    state = state.select(
        "symbol", "ts", "trend_regime", "trend_quality", F.col("realized_vol_20").alias("volatility_measure"), "volatility_percentile", "volatility_reference_count",
        F.round(F.col("atr_14") / F.col("close"), 10).alias("atr_pct"), momentum(F.col("rsi_14"), F.col("roc_12"), F.col("macd")).alias("momentum_regime"),
        participation(F.col("relative_volume_20")).alias("participation_regime"), "rsi_14", "roc_12", "macd", "relative_volume_20",
    )
    state = state.withColumn("volatility_regime", volatility(F.col("volatility_percentile")))
    state = state.withColumn("composite_regime", composite(F.col("trend_regime"), F.col("volatility_regime")))
    for d in DIMENSIONS:
        state = with_runs(state, f"{d}_regime", run="__run", age=f"{d}_age")
        state = state.withColumn(f"{d}_changed", (F.col(f"{d}_age") == 1) & (F.col("__run") > 1)).drop("__run")
    return state
