"""Technical indicators over each instrument's bars: trailing full windows, recursive smoothers, nothing from later bars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import full, lagged, prior, prior_mean, ratio, rolling_mean, running, smoothed, trailing


@dataclass(frozen=True)
class IndicatorConfig:
    """Periods (fixed values)."""

    sma: tuple[int, ...] = (20, 50, 200)
    ema: tuple[int, ...] = (20, 50, 200)
    macd: tuple[int, int, int] = (12, 26, 9)
    rsi: int = 14
    stoch: tuple[int, int, int] = (14, 3, 3)
    roc: int = 12
    atr: int = 14
    bollinger: tuple[int, float] = (20, 2.0)
    realized_vol: int = 20
    year: int = 252
    relative_volume: int = 20


CONFIG = IndicatorConfig()


def true_range() -> Column:
    """Largest of the bar's range and its distances from the previous close; null on the first bar."""
    before = lagged("close")
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def roc(n: int) -> Column:
    return F.round(100.0 * (F.try_divide(F.col("close"), lagged("close", n)) - 1), 10)


def realized_volatility(df: DataFrame, n: int, year: int) -> DataFrame:
    with_returns = df.withColumn("log_return", F.ln(F.try_divide(F.col("close"), lagged("close"))))
    return with_returns.withColumn(f"realized_vol_{n}", full(F.stddev_samp("log_return"), F.col("log_return"), trailing(n), n) * float(year) ** 0.5)


def obv(df: DataFrame) -> DataFrame:
    """Running sum of volume by the sign of the close's change, 0 on the first bar; null from the first missing volume on."""
    step = df.withColumn("__step", F.coalesce(F.signum(F.col("close") - lagged("close")), F.lit(0.0)) * F.col("volume"))
    missing = F.max(F.col("__step").isNull().cast("int")).over(running())
    return step.withColumn("obv", F.when(missing == 0, F.sum("__step").over(running()))).drop("__step")


def windowed(bars: DataFrame, cfg: IndicatorConfig = CONFIG) -> DataFrame:
    """The indicators that window frames express."""
    df = bars
    for n in cfg.sma:
        df = df.withColumn(f"sma_{n}", rolling_mean("close", n))
    n, k_n, d_n = cfg.stoch
    high, low = full(F.max("high"), F.col("high"), trailing(n), n), full(F.min("low"), F.col("low"), trailing(n), n)
    df = df.withColumn("stoch_raw_k", ratio(100.0 * (F.col("close") - low), high - low))
    df = df.withColumn("stoch_k", rolling_mean("stoch_raw_k", k_n)).withColumn("stoch_d", rolling_mean("stoch_k", d_n))
    df = df.withColumn(f"roc_{cfg.roc}", roc(cfg.roc)).withColumn("true_range", true_range())
    n, k = cfg.bollinger
    spread = k * full(F.stddev_pop("close"), F.col("close"), trailing(n), n)
    df = df.withColumns({"bb_middle": rolling_mean("close", n), "__spread": spread})
    df = df.withColumns({"bb_upper": F.col("bb_middle") + F.col("__spread"), "bb_lower": F.col("bb_middle") - F.col("__spread")})
    df = df.withColumns({"bb_width_pct": ratio(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_middle")), "bb_percent_b": ratio(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower"))})
    df = realized_volatility(df.drop("__spread"), cfg.realized_vol, cfg.year).drop("log_return")
    n = cfg.relative_volume
    return obv(df.withColumn(f"relative_volume_{n}", ratio(F.col("volume"), prior_mean("volume", n))))


def recursive(df: DataFrame, cfg: IndicatorConfig = CONFIG) -> DataFrame:
    """EMA, MACD, RSI and ATR; df has true_range. All first-level smoothers share one pass over an instrument."""
    fast, slow, signal = cfg.macd
    change = F.col("close") - lagged("close")
    df = df.withColumns({"__gain": F.greatest(change, F.lit(0.0)), "__loss": F.greatest(-change, F.lit(0.0))})
    df = df.withColumns({c: F.when(change.isNotNull(), F.col(c)) for c in ("__gain", "__loss")})
    spans = {f"ema_{n}": ("close", n, 2.0 / (n + 1)) for n in cfg.ema} | {"__fast": ("close", fast, 2.0 / (fast + 1)), "__slow": ("close", slow, 2.0 / (slow + 1))}
    wilder = {"__up": ("__gain", cfg.rsi, 1.0 / cfg.rsi), "__down": ("__loss", cfg.rsi, 1.0 / cfg.rsi), f"atr_{cfg.atr}": ("true_range", cfg.atr, 1.0 / cfg.atr)}
    df = smoothed(df, spans | wilder).withColumn("macd", F.col("__fast") - F.col("__slow"))
    total = F.col("__up") + F.col("__down")
    df = df.withColumn(f"rsi_{cfg.rsi}", F.round(F.try_divide(100.0 * F.col("__up"), total), 10))
    df = smoothed(df, {"macd_signal": ("macd", signal, 2.0 / (signal + 1))}).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return df.drop("__gain", "__loss", "__fast", "__slow", "__up", "__down")


def analyse(bars: DataFrame, cfg: IndicatorConfig = CONFIG) -> DataFrame:
    """bars with all indicators."""
    return recursive(windowed(bars, cfg), cfg)


def catalog(cfg: IndicatorConfig = CONFIG) -> list[tuple[str, str, int]]:
    """(column, family, rows before its first value)."""
    fast, slow, signal = cfg.macd
    n, k, d = cfg.stoch
    return (
        [(f"sma_{p}", "trend", p - 1) for p in cfg.sma]
        + [(f"ema_{p}", "trend", p - 1) for p in cfg.ema]
        + [("macd", "trend", slow - 1), ("macd_signal", "trend", slow + signal - 2), ("macd_hist", "trend", slow + signal - 2)]
        + [(f"rsi_{cfg.rsi}", "momentum", cfg.rsi), ("stoch_raw_k", "momentum", n - 1), ("stoch_k", "momentum", n + k - 2), ("stoch_d", "momentum", n + k + d - 3), (f"roc_{cfg.roc}", "momentum", cfg.roc)]
        + [("true_range", "volatility", 1), (f"atr_{cfg.atr}", "volatility", cfg.atr)]
        + [(c, "volatility", cfg.bollinger[0] - 1) for c in ("bb_middle", "bb_upper", "bb_lower", "bb_width_pct", "bb_percent_b")]
        + [(f"realized_vol_{cfg.realized_vol}", "volatility", cfg.realized_vol), (f"relative_volume_{cfg.relative_volume}", "volume", cfg.relative_volume), ("obv", "volume", 0)]
    )
