"""Intraday features, signals of three strategies, regimes with vetoes, and bracket trades with costs in units of risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.functions.scans import taken
from tidemark.functions.semantics import by, full, lagged, prior, ratio, rolling_mean, smoothed, trailing, with_ranks
from tidemark.operators.indicators import true_range

#: Bars that a signal's position is held at most (fixed values).
HOLD = {"pullback": 48, "breakout": 24, "reversion": 16}


def session_flags(ts: Column) -> dict[str, Column]:
    """Whether London or New York is open (8 to 17 local), whether the day's roll at 17:00 New York is near, and both joined."""
    minute = lambda zone: F.hour(calendar.local(ts, zone)) * 60 + F.minute(calendar.local(ts, zone))
    london, new_york = minute("Europe/London"), minute("America/New_York")
    liquid = ((london >= 480) & (london < 1020)) | ((new_york >= 480) & (new_york < 1020))
    roll = (new_york >= 990) & (new_york < 1035)
    return {"liquid": liquid, "near_rollover": roll, "tradable": liquid & ~roll}


def features(bars: DataFrame) -> DataFrame:
    """bars (symbol, ts, open, high, low, close, spread) with ATR, its mean of 50 and its rank among the last 200 (ties in the
    middle, from 100 on), efficiency, RSI, three EMAs, Bollinger bands and session flags. One fold holds all smoothers."""
    move = F.col("close") - lagged("close")
    b = bars.select("symbol", "ts", "open", "high", "low", "close", "spread", true_range().alias("__range"), F.greatest(move, 0 * move).alias("__gain"), F.greatest(-move, 0 * move).alias("__loss"), F.abs(move).alias("__way"))
    spans = {f"ema_{n}": ("close", n, 2.0 / (n + 1)) for n in (20, 50, 200)}
    b = smoothed(b, spans | {"atr": ("__range", 14, 1 / 14), "__up": ("__gain", 14, 1 / 14), "__down": ("__loss", 14, 1 / 14)})
    b = b.withColumn("atr", F.round("atr", 10))
    ranked = with_ranks(b, "atr", 199)
    seen = F.col("__count") + 1
    path = full(F.sum("__way"), F.col("__way"), trailing(20), 20)
    band = 2.0 * full(F.stddev_pop("close"), F.col("close"), trailing(20), 20)
    out = ranked.withColumns({
        "atr_sma": rolling_mean("atr", 50), "atr_pct": F.when(F.col("atr").isNotNull() & (seen >= 100), (F.col("__below") + F.col("__equal") / 2 + 1) / seen),
        "er": ratio(F.abs(F.col("close") - lagged("close", 20)), path), "rsi": ratio(100 * F.col("__up"), F.col("__up") + F.col("__down")),
        "bb_middle": rolling_mean("close", 20), "__band": band,
    })
    out = out.withColumns({"bb_lower": F.col("bb_middle") - F.col("__band"), "bb_upper": F.col("bb_middle") + F.col("__band"), **session_flags(F.col("ts"))})
    return out.drop("__range", "__gain", "__loss", "__way", "__up", "__down", "__below", "__equal", "__count", "__band")


def _emit(f: DataFrame, strategy: str, side) -> DataFrame:
    """symbol, ts, dir, stop_dist, target_dist, score, max_hold of the bars at which side(1) or side(-1) holds; side gives the
    condition, both distances and the score."""
    both = []
    for d in (1, -1):
        holds, stop, target, score = side(d)
        row = F.struct(F.lit(d).alias("dir"), stop.alias("stop_dist"), target.alias("target_dist"), score.alias("score"), F.lit(HOLD[strategy]).alias("max_hold"))
        both.append(F.when(holds, row))
    return f.withColumn("__s", F.coalesce(*both)).where("__s is not null").select("symbol", "ts", "__s.*")


def pullback_signals(f: DataFrame) -> DataFrame:
    """With the trend of three averages whose middle one rises by half an ATR in 20 bars, after a touch of the fast average."""
    slope = F.try_divide(F.col("ema_50") - lagged("ema_50", 20), F.col("atr"))
    touches = {1: F.coalesce(F.col("low") <= F.col("ema_20"), F.lit(False)), -1: F.coalesce(F.col("high") >= F.col("ema_20"), F.lit(False))}
    f = f.withColumns({"__slope": slope, "__touch1": F.max(touches[1]).over(trailing(3)), "__touch-1": F.max(touches[-1]).over(trailing(3))})

    def side(d: int):
        stacked = (d * F.col("close") > d * F.col("ema_200")) & (d * F.col("ema_20") > d * F.col("ema_50")) & (d * F.col("close") > d * F.col("ema_20"))
        apart = F.least(F.try_divide(F.abs(F.col("ema_20") - F.col("ema_50")), F.col("atr")), F.lit(2.0)) / 2
        score = 0.55 + 0.25 * apart + 0.2 * F.least(F.abs("__slope") / 3, F.lit(1.0))
        return stacked & (d * F.col("__slope") >= 0.5) & F.col(f"__touch{d}"), 2.0 * F.col("atr"), 3.0 * F.col("atr"), score

    return _emit(f, "pullback", side)


def breakout_signals(f: DataFrame) -> DataFrame:
    """Closes beyond the channel of the 20 bars before, on the far average's side, while ranges grow and the RSI is 5 to 30 from
    its middle."""
    f = f.withColumns({"__edge1": full(F.max("high"), F.col("high"), prior(20), 20), "__edge-1": full(F.min("low"), F.col("low"), prior(20), 20)})

    def side(d: int):
        beyond = (d * F.col("close") > d * F.col(f"__edge{d}")) & (d * F.col("close") > d * F.col("ema_200"))
        driven = (F.col("atr") > F.col("atr_sma")) & (d * (F.col("rsi") - 50)).between(5, 30)
        growth = F.least(F.greatest(F.try_divide("atr", "atr_sma") - 1, F.lit(0.0)), F.lit(1.0))
        score = 0.55 + 0.25 * F.least(F.abs(F.col("rsi") - 50) / 30, F.lit(1.0)) + 0.2 * growth
        return beyond & driven, 1.5 * F.col("atr"), 2.5 * F.col("atr"), score

    return _emit(f, "breakout", side)


def reversion_signals(f: DataFrame) -> DataFrame:
    """A close back inside the band after one outside with an extreme RSI, in a range; the middle must lie at least 1.2 times as
    far as the stop, which stands half an ATR behind the extreme of three bars."""
    w = trailing(3)
    f = f.withColumns({"__stop1": F.col("close") - F.min("low").over(w), "__stop-1": F.max("high").over(w) - F.col("close"), "__was": lagged("close"), "__rsi": lagged("rsi"), "__band1": lagged("bb_lower"), "__band-1": lagged("bb_upper")})

    def side(d: int):
        band = F.col("bb_lower" if d > 0 else "bb_upper")
        back = (d * F.col("__was") < d * F.col(f"__band{d}")) & (d * F.col("close") > d * band) & (d * (50 - F.col("__rsi")) >= 15)
        stop, target = F.col(f"__stop{d}") + 0.5 * F.col("atr"), F.abs(F.col("bb_middle") - F.col("close"))
        return (F.col("er") <= 0.25) & back & (target >= 1.2 * stop), stop, target, 0.55 + 0.45 * F.least(F.abs(50 - F.col("__rsi")) / 50, F.lit(1.0))

    return _emit(f, "reversion", side)


def regime(f: DataFrame) -> DataFrame:
    """symbol, ts, regime, veto: extreme ranges first, then efficiency; an undefined measure decides nothing. No trade while
    volatile or quiet, with a spread above 0.3 ATR, or outside the tradable hours."""
    volatile, quiet = (F.coalesce(c, F.lit(False)) for c in (F.col("atr_pct") >= 0.97, F.col("atr_pct") <= 0.03))
    wide = F.coalesce(F.try_divide("spread", "atr") > 0.30, F.lit(False))
    label = F.when(volatile, "volatile").when(quiet, "quiet").when(F.col("er") >= 0.30, "trending").when(F.col("er") <= 0.18, "ranging").otherwise("mixed")
    return f.select("symbol", "ts", label.alias("regime"), (volatile | quiet | wide | ~F.col("tradable")).alias("veto"))


def bracket_exits(bars: DataFrame, signals: DataFrame, spread: float = 0.0002, gap: int = 7200) -> DataFrame:
    """Each signal on its own: entry at the next open, on ask or bid, and the first bar at which the opening gap, the stop, the
    goal, time (max_hold bars) or a pause of the market (more than gap seconds; the end of the data is one) ends it. A signal just
    before a pause, or with no positive distances, enters nothing. Signals meet the bars of their horizon by position."""
    later = F.lead("ts").over(by())
    pause = F.coalesce(F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")) > gap, F.lit(True))
    b = bars.withColumns({"i": F.row_number().over(by()), "pause": pause, "day": calendar.trading_day(F.col("ts"))}).select("symbol", "ts", "i", "pause", "day", "open", "high", "low", "close")
    sound = signals.where("dir <> 0 and stop_dist > 0 and target_dist > 0 and not isnan(stop_dist) and not isnan(target_dist)").select("symbol", "ts", "dir", "stop_dist", "target_dist", F.greatest("max_hold", F.lit(1)).alias("hold"))
    at = sound.join(b.where(~F.col("pause")).select("symbol", "ts", "i"), ["symbol", "ts"])
    entry = b.select("symbol", (F.col("i") - 1).alias("i"), F.col("ts").alias("entry_ts"), F.col("day").alias("first_day"), F.col("open").alias("first_open"))
    opened = at.join(entry, ["symbol", "i"]).withColumn("entry", F.col("first_open") * (1 + F.col("dir") * spread / 2))
    walked = opened.withColumn("age", F.explode(F.sequence(F.lit(1), F.col("hold")))).withColumn("j", F.col("i") + F.col("age"))
    path = walked.join(b.select("symbol", F.col("i").alias("j"), F.col("ts").alias("exit_ts"), "pause", "day", *[(F.col(c)).alias(c) for c in ("open", "high", "low", "close")]), ["symbol", "j"])
    # Prices times direction, on the side at which the position is closed: a short's low is its best price.
    d = F.col("dir")
    signed = lambda c: d * F.col(c) * (1 - d * spread / 2)
    worst, best = F.when(d > 0, signed("low")).otherwise(signed("high")), F.when(d > 0, signed("high")).otherwise(signed("low"))
    path = path.withColumns({"__open": signed("open"), "__close": signed("close"), "__worst": worst, "__best": best, "__stop": d * F.col("entry") - F.col("stop_dist"), "__goal": d * F.col("entry") + F.col("target_dist")})
    rules = (
        ("stop_gap", F.col("__open") <= F.col("__stop"), "__open"), ("stop", F.col("__worst") <= F.col("__stop"), "__stop"), ("target_gap", (F.col("age") > 1) & (F.col("__open") >= F.col("__goal")), "__open"),
        ("target", F.col("__best") >= F.col("__goal"), "__goal"), ("time", F.col("age") >= F.col("hold"), "__close"), ("weekend", F.col("pause"), "__close"),
    )
    ended = path.withColumn("__end", F.coalesce(*[F.when(holds, F.struct(F.lit(name).alias("reason"), (d * F.col(price)).alias("exit"))) for name, holds, price in rules])).where("__end is not null")
    kept = F.struct("i", "dir", "entry_ts", "entry", "stop_dist", "target_dist", "exit_ts", "__end.exit", "__end.reason", "age", F.datediff("day", "first_day").alias("nights"))
    return ended.groupBy("symbol", "ts").agg(F.min_by(kept, "age").alias("x")).select("symbol", F.col("ts").alias("signal_ts"), "x.*")


def _costs(exits: DataFrame, equity: float, percent: float, commission: float, least: float, financing: float, euro: float, dollar: float) -> DataFrame:
    """The exits with results in units of the risk taken: both orders' commission with its minimum, and financing by night."""
    risk = equity * percent / 100 * euro
    notional = risk / F.col("stop_dist") * F.col("entry")
    fee = 2 * F.greatest(F.lit(least * dollar), commission * 1e-4 * notional)
    gross = F.col("dir") * (F.col("exit") - F.col("entry")) / F.col("stop_dist")
    cost = (fee + F.col("nights") * financing * 1e-4 * notional) / risk
    named = exits.select("symbol", "i", "signal_ts", "dir", "entry_ts", "exit_ts", "entry", "exit", "reason", F.col("age").alias("bars"), "nights", gross.alias("r_gross"), cost.alias("r_cost"))
    return named.withColumn("r_net", F.col("r_gross") - F.col("r_cost"))


def bracket_trades(bars: DataFrame, signals: DataFrame, spread: float = 0.0002, equity: float = 10_000.0, percent: float = 0.5, commission: float = 0.2, least: float = 2.0, financing: float = 0.5, euro: float = 1.1, dollar: float = 1.0, max_hold: int | None = None) -> DataFrame:
    """One position a symbol at a time: a signal before the exit bar of an open position is passed over. max_hold bounds the signals' own. Commission and financing
    are in basis points (a side, a night), least in dollars; euro and dollar convert to the quoted currency. Exits are known from
    bracket_exits, so what is left is to take intervals of bars one after the other, which block scans do (scans.taken)."""
    exits = _costs(bracket_exits(bars, signals, spread), equity, percent, commission, least, financing, euro, dollar)
    longest = max(HOLD.values()) if max_hold is None else max_hold
    return taken(exits.withColumn("__end", F.col("i") + F.col("bars")), "i", "__end", longest, "symbol").drop("i", "__end")
