"""Rule strategies: a state LONG, FLAT or INSUFFICIENT_DATA for each bar and strategy, and when it is seen and takes effect."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import by, running

LONG, FLAT, INSUFFICIENT = "LONG", "FLAT", "INSUFFICIENT_DATA"


@dataclass(frozen=True)
class Strategy:
    """A rule sees only the columns that it declares. decide maps these columns to (missing, long)."""

    name: str
    features: tuple[str, ...]
    decide: Callable[..., tuple[Column, Column]]

    def state(self) -> Column:
        missing, long = self.decide(*[F.col(f) for f in self.features])
        return F.when(missing, INSUFFICIENT).when(long, LONG).otherwise(FLAT)


def _label(wanted: str) -> Callable[[Column], tuple[Column, Column]]:
    return lambda label: (label.isNull() | (label == "insufficient_data"), label == wanted)


BUY_AND_HOLD = Strategy("buy_and_hold", ("close",), lambda close: (close.isNull(), close.isNotNull()))
SMA_TREND = Strategy("sma_trend", ("close", "sma_200"), lambda close, sma: (close.isNull() | sma.isNull(), close > sma))
SMA_CROSSOVER = Strategy("sma_crossover", ("sma_20", "sma_50"), lambda fast, slow: (fast.isNull() | slow.isNull(), fast > slow))
RSI_MOMENTUM = Strategy("rsi_momentum", ("rsi_14",), lambda rsi: (rsi.isNull(), rsi > 50))
PRICE_ACTION_TREND = Strategy("price_action_trend", ("structure",), _label("uptrend"))
REGIME_TREND = Strategy("regime_trend", ("composite_regime",), _label("trending_up"))
BASELINES = (BUY_AND_HOLD, SMA_TREND, SMA_CROSSOVER, RSI_MOMENTUM, PRICE_ACTION_TREND, REGIME_TREND)


def states(features: DataFrame, strategies: tuple[Strategy, ...]) -> DataFrame:
    """symbol, ts, strategy, state, state_in_effect, changed: one row for each bar and strategy."""
    each = F.explode(F.array(*[F.struct(F.lit(s.name).alias("strategy"), s.state().alias("state")) for s in strategies]))
    long = features.select("symbol", "ts", each.alias("s")).select("symbol", "ts", "s.*")
    before = F.lag("state").over(by("symbol", "strategy"))
    return long.select("*", before.alias("state_in_effect"), F.coalesce(F.col("state") != before, F.lit(False)).alias("changed"))


def effective(signals: DataFrame, calendar: DataFrame) -> DataFrame:
    """Signals with effective_at, the next session's start from the calendar (ts, next_ts), not the next bar."""
    return signals.join(calendar.select("ts", F.col("next_ts").alias("effective_at")), "ts")


def targets(signals: DataFrame) -> DataFrame:
    """Signals with the position that each asks for; insufficient data keeps the one before, which is 0 at first."""
    asked = F.when(F.col("state") == LONG, 1.0).when(F.col("state") == FLAT, 0.0)
    return signals.withColumn("target", F.coalesce(F.last(asked, ignorenulls=True).over(running("symbol", "strategy")), F.lit(0.0)))


def summary(signals: DataFrame) -> DataFrame:
    decided = F.col("state") != INSUFFICIENT
    return signals.groupBy("symbol", "strategy").agg(
        F.count("*").alias("bars"), F.count_if(F.col("state") == LONG).alias("long"), F.count_if(F.col("state") == FLAT).alias("flat"),
        F.count_if(~decided).alias("insufficient"), F.count_if("changed").alias("changes"), F.min(F.when(decided, F.col("ts"))).alias("first_decided"),
    )
