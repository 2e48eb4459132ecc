"""Position sizing as column expressions, stops, and the drawdown monitor's states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import full, lagged, smoothed, trailing
from tidemark.operators.indicators import true_range


def sizes(bars: DataFrame, target_vol: float = 0.10, risk: float = 0.01, multiple: float = 2.0, fraction: float = 0.5) -> DataFrame:
    """symbol, ts, method, exposure, reason: full, fixed fraction, volatility target, and risk per ATR. An undefined or
    non-positive input sizes 0 with its reason, never a default; no exposure passes 1."""
    df = bars.select("symbol", "ts", "close", F.ln(F.try_divide(F.col("close"), lagged("close"))).alias("__lr"), true_range().alias("__range"))
    df = df.withColumn("__vol", full(F.stddev_samp("__lr"), F.col("__lr"), trailing(20), 20) * 252**0.5)
    df = smoothed(df, {"__atr": ("__range", 14, 1 / 14)})

    def sized(name: str, raw: Column, known: Column) -> Column:
        known = F.coalesce(known, F.lit(False))
        reason = F.when(known, name).otherwise("risk_input_undefined")
        return F.struct(F.lit(name).alias("method"), F.when(known, F.least(raw, F.lit(1.0))).otherwise(0.0).alias("exposure"), reason.alias("reason"))

    always = F.lit(True)
    each = F.array(
        sized("full", F.lit(1.0), always), sized("fixed_fraction", F.lit(fraction), always), sized("volatility_target", F.try_divide(F.lit(target_vol), F.col("__vol")), F.col("__vol") > 0),
        sized("atr_risk", F.try_divide(risk * F.col("close"), multiple * F.col("__atr")), (F.col("__atr") > 0) & (F.col("close") > 0)),
    )
    return df.select("symbol", "ts", F.explode(each).alias("s")).select("symbol", "ts", "s.*")


def stop_level(entry: Column, kind: str, percent: float = 0.05, reach: Column | None = None, multiple: float = 2.0) -> Column:
    """Set once at entry; null without a stop."""
    return {"none": F.lit(None).cast("double"), "fixed_pct": entry * (1 - percent), "atr": entry - multiple * reach if reach is not None else F.lit(None).cast("double")}[kind]


def stopped(close: Column, low: Column, level: Column) -> tuple[Column, Column]:
    """(triggered on the close, touched within the bar)."""
    return F.coalesce(close <= level, F.lit(False)), F.coalesce(low <= level, F.lit(False))


STATES = "ts timestamp_ntz, equity double, high_water double, drawdown double, risk_state string, sessions_locked long"


def drawdown_states(equity: DataFrame, *keys: str, warning: float = 0.10, lock: float = 0.20, cooldown: int = 20) -> DataFrame:
    """NORMAL, WARNING or LOCKED at each close. A lock lasts its cooldown and then restarts the high-water mark, so each state
    depends on the one before: a fold over each key's series."""

    def run(group):
        import pandas as pd

        group = group.sort_values("ts")
        high, locked, rows = float("-inf"), 0, []
        for ts, value in group[["ts", "equity"]].itertuples(index=False, name=None):
            if locked > cooldown:
                high, locked = value, 0
            high = max(high, value)
            down = value / high - 1 if high > 0 else 0.0
            locked = locked + 1 if locked or -down >= lock else 0
            rows.append((ts, value, high, down, "LOCKED" if locked else "WARNING" if -down >= warning else "NORMAL", locked))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in STATES.split(", ")])
        for k in reversed(keys):
            out.insert(0, k, group[k].iloc[0])
        return out

    schema = ", ".join(f"`{k}` {equity.schema[k].dataType.simpleString()}" for k in keys) + ", " + STATES
    return equity.select(*keys, "ts", "equity").groupBy(*keys).applyInPandas(run, schema)
