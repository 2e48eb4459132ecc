"""Candle geometry and candlestick shapes, as column expressions over each instrument's bars.

A value at a bar uses that bar and earlier ones. Candles without range are valid but have no ratios and form no shape;
candles with impossible prices have no geometry at all.

A shape is written once, as SQL over the last candles seen from a side: seen from "up" a candle is as it is, seen from "down" its
prices are negated, so that highs and lows, gains and losses, and the wicks change places. One text thus gives the
bullish shape and its bearish twin.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import RATIO_DECIMALS, by, lagged, positive_ratio, prior_mean

#: Bars behind the trend and the score from which it counts; bars of usual volume and of usual bodies.
TREND_BARS, TREND_FROM = 10, 1.0
VOLUME_BARS, BODY_BARS = 20, 20


def geometry(bars: DataFrame) -> DataFrame:
    """symbol, ts, OHLCV and 18 columns of geometry and context."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    top, bottom = F.greatest(o, c), F.least(o, c)
    present = o.isNotNull() & h.isNotNull() & lo.isNotNull() & c.isNotNull() & v.isNotNull()
    valid = F.coalesce(present & (h >= top) & (lo <= bottom) & (lo > 0) & (v >= 0), F.lit(False))
    g = bars.select("symbol", "ts", "open", "high", "low", "close", "volume", valid.alias("valid"))
    ok = lambda x: F.when(F.col("valid"), x)
    g = g.withColumns({"range": ok(h - lo), "body": ok(c - o), "upper_wick": ok(h - top), "lower_wick": ok(bottom - lo), "close_ok": ok(c)})
    g = g.withColumns({"zero_range": F.col("valid") & (F.coalesce(F.col("range"), F.lit(1.0)) == 0), "abs_body": F.abs("body")})
    g = g.withColumn("usable", F.col("valid") & ~F.col("zero_range"))
    den = F.when(F.col("usable"), F.col("range"))
    g = g.withColumns(
        {
            "body_ratio": positive_ratio(F.col("abs_body"), den),
            "upper_wick_ratio": positive_ratio(F.col("upper_wick"), den),
            "lower_wick_ratio": positive_ratio(F.col("lower_wick"), den),
            "close_position": positive_ratio(F.col("close_ok") - lo, den),
            "direction": F.when(F.col("body") > 0, "bullish").when(F.col("body") < 0, "bearish").when(F.col("valid"), "neutral").otherwise("invalid"),
            "gap": F.round(F.try_divide(ok(o), lagged("close_ok")) - 1, RATIO_DECIMALS),
            "relative_volume": positive_ratio(ok(v), prior_mean(ok(v), VOLUME_BARS)),
            "avg_body_prior": prior_mean("abs_body", BODY_BARS),
            "trend_score": positive_ratio(lagged("close_ok") - lagged("close_ok", TREND_BARS + 1), prior_mean("range", TREND_BARS)),
        }
    )
    score = F.col("trend_score")
    trend = F.when(score >= TREND_FROM, "up").when(score <= -TREND_FROM, "down").when(score.isNotNull(), "none").otherwise("unknown")
    return g.withColumn("prior_trend", trend).drop("close_ok")


@dataclass(frozen=True)
class Shape:
    """A shape of the last ``bars`` candles x0 (which completes it), x1, ...

    A candle has start, end, peak and pit (its prices from the side), body, nose and tail (shares of its range: body, wick at the
    peak, wick at the pit), size, tail_size and span (of body, tail and range), usual (size of the bodies before), gains and
    loses. ``where`` is the condition; each entry of ``grade`` is a measure with the values at which it scores 0 and 1.
    """

    family: str
    bars: int
    where: str
    grade: tuple[tuple[str, float, float], ...]
    #: Names from either side. A side may have a name for each trend before it; the shape then stands only in these trends.
    up: str | dict[str, str]
    down: str | dict[str, str] | None = None
    #: Of a shape without sides: "neutral", or "own" for the last candle's direction.
    way: str | None = None


def share(part: str, whole: str) -> str:
    return f"(CASE WHEN {whole} > 0 THEN round(try_divide({part}, {whole}), {RATIO_DECIMALS}) END)"


_APART = share("abs(x0.pit - x1.pit)", "((x0.span + x1.span) / 2)")
_REGAINED = share("(x0.end - x2.end)", "(x2.start - x2.end)")
_WIDTH = share("x0.span", "x1.span")
_GROWN = share("x0.size", "x1.size")
_UNUSUAL = share("x0.size", "x0.usual")
STAR = f"x2.loses AND x0.gains AND x2.body >= 0.5 AND x1.body <= 0.3 AND x0.body >= 0.5 AND greatest(x1.start, x1.end) <= x2.end AND {_REGAINED} >= 0.5"

#: The shapes, with fixed values for their names, families, thresholds and scores.
SHAPES = (
    Shape("indecision", 1, "x0.body <= 0.1", (("x0.body", 0.1, 0.0),), "doji", way="neutral"),
    Shape("indecision", 1, "x0.body > 0.1 AND x0.body <= 0.3 AND x0.nose >= 0.25 AND x0.tail >= 0.25", (("x0.nose", 0.25, 0.5), ("x0.tail", 0.25, 0.5)), "spinning_top", way="neutral"),
    Shape("momentum", 1, "x0.body >= 0.9 AND x0.nose <= 0.05 AND x0.tail <= 0.05", (("x0.body", 0.9, 1.0),), "marubozu", way="own"),
    Shape("momentum", 1, f"x0.body >= 0.6 AND {_UNUSUAL} >= 1.5", ((_UNUSUAL, 1.5, 3.0), ("x0.body", 0.6, 1.0)), "long_body", way="own"),
    Shape(
        "reversal", 1, "x0.body <= 0.3 AND x0.tail >= 0.6 AND x0.nose <= 0.1 AND x0.tail_size >= 2 * x0.size",
        (("x0.tail", 0.6, 1.0), ("x0.nose", 0.1, 0.0), ("x0.body", 0.3, 0.0)),
        {"down": "hammer", "up": "hanging_man"}, {"down": "inverted_hammer", "up": "shooting_star"},
    ),
    Shape(
        "reversal", 2, "x1.loses AND x0.gains AND x1.body > 0.1 AND x0.start <= x1.end AND x0.end >= x1.start AND x0.size > x1.size",
        ((f"ln({_GROWN})", 0.0, math.log(10.0)),), "bullish_engulfing", "bearish_engulfing",
    ),
    Shape("reversal", 2, f"x1.loses AND x0.gains AND {_APART} <= 0.05", ((_APART, 0.05, 0.0),), "tweezer_bottom", "tweezer_top"),
    Shape("structure", 2, "x0.peak < x1.peak AND x0.pit > x1.pit", ((_WIDTH, 1.0, 0.0),), "inside_bar", way="neutral"),
    Shape("structure", 2, "x0.peak > x1.peak AND x0.pit < x1.pit", ((_WIDTH, 1.0, 3.0),), "outside_bar", way="neutral"),
    Shape("reversal", 3, STAR, (("x2.body", 0.5, 1.0), ("x1.body", 0.3, 0.0), ("x0.body", 0.5, 1.0), (_REGAINED, 0.5, 1.0)), "morning_star", "evening_star"),
    Shape(
        "continuation", 3,
        " AND ".join(f"x{k}.gains AND x{k}.body >= 0.5 AND x{k}.nose <= 0.25" for k in (2, 1, 0))
        + "".join(f" AND x{k - 1}.end > x{k}.end AND x{k - 1}.start BETWEEN least(x{k}.start, x{k}.end) AND greatest(x{k}.start, x{k}.end)" for k in (2, 1)),
        tuple((f"x{k}.body", 0.5, 1.0) for k in (2, 1, 0)), "three_white_soldiers", "three_black_crows",
    ),
    Shape(
        "continuation", 5,
        "x4.gains AND x0.gains AND x4.body >= 0.5 AND x0.body >= 0.5 AND x0.end > x4.end" + "".join(f" AND x{k}.peak <= x4.peak AND x{k}.pit >= x4.pit AND x{k}.size < x4.size" for k in (3, 2, 1)),
        (("x4.body", 0.5, 1.0), ("x0.body", 0.5, 1.0)), "rising_three_methods", "falling_three_methods",
    ),
)
SIDES = {"up": (1.0, "bullish", "bearish"), "down": (-1.0, "bearish", "bullish")}


def _seen(side: str) -> Column:
    """A candle from a side."""
    sign, gains, loses = SIDES[side]
    turned = (lambda *x: x) if sign > 0 else lambda *x: x[::-1]
    peak, pit = turned("high", "low")
    nose, tail = turned("upper_wick_ratio", "lower_wick_ratio")
    prices = {"start": "open", "end": "close", "peak": peak, "pit": pit}
    rest = {"body": "body_ratio", "nose": nose, "tail": tail, "size": "abs_body", "tail_size": turned("upper_wick", "lower_wick")[1], "span": "range", "usual": "avg_body_prior"}
    return F.struct(
        *[(F.col(c) * sign).alias(n) for n, c in prices.items()],
        *[F.col(c).alias(n) for n, c in rest.items()],
        (F.col("direction") == gains).alias("gains"),
        (F.col("direction") == loses).alias("loses"),
    )


def recent(g: DataFrame, bars: int = 5) -> DataFrame:
    """symbol, ts, direction and the last candles as structs x0, x1, ...; all come from one window."""
    candle = F.struct("ts", "usable", "prior_trend", *[_seen(side).alias(side) for side in SIDES])
    g = g.select("symbol", "ts", "direction", candle.alias("x0"))
    return g.select("*", *[F.lag("x0", k).over(by()).alias(f"x{k}") for k in range(1, bars)])


def matches(shape: Shape, side: str) -> Column:
    """Whether the last candles, all usable, have the shape from a side."""
    usable = " AND ".join(f"x{k}.usable" for k in range(shape.bars))
    return F.coalesce(F.expr(f"{usable} AND {_from(side, shape.where)}"), F.lit(False))


def _from(side: str, text: str) -> str:
    return re.sub(r"\bx(\d)\.", rf"x\1.{side}.", text)


def strength(shape: Shape, side: str) -> Column:
    """Mean of the defined scores, each between 0 and 1."""
    scores = [F.expr(f"greatest(0D, least(1D, (({m}) - {zero!r}D) / ({one!r}D - {zero!r}D)))") for m, zero, one in ((_from(side, m), z, o) for m, z, o in shape.grade)]
    known = F.array_compact(F.array(*scores))
    return F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))


def _forms(shape: Shape):
    """(side, name, orientation, trend asked for, whether the name hangs on it) of a shape's forms."""
    if shape.way:
        yield "up", shape.up, F.col("direction") if shape.way == "own" else F.lit(shape.way), None, False
        return
    for side in SIDES:
        names = getattr(shape, side)
        if isinstance(names, dict):
            for trend, name in names.items():
                yield side, name, F.lit("bullish" if trend == "down" else "bearish"), trend, True
        else:
            against = "down" if side == "up" else "up"
            yield side, names, F.lit(SIDES[side][1]), against if shape.family == "reversal" else None, False


def observations(g: DataFrame, shapes: tuple[Shape, ...] = SHAPES) -> DataFrame:
    """A row for each shape that a bar completes: symbol, ts, first_bar_ts, pattern, family, bars, orientation, context_required,
    trend_before, context_met, strength. Own shapes may be passed beside SHAPES."""
    rows = []
    for shape in shapes:
        first = F.col(f"x{shape.bars - 1}")
        before = first["prior_trend"]
        for side, name, orientation, trend, named in _forms(shape):
            met = F.coalesce(before == trend, F.lit(False)) if trend else F.lit(None).cast("boolean")
            fields = F.struct(
                F.lit(name).alias("pattern"), F.lit(shape.family).alias("family"), F.lit(shape.bars).alias("bars"), orientation.alias("orientation"),
                F.lit(trend).cast("string").alias("context_required"), before.alias("trend_before"), met.alias("context_met"),
                strength(shape, side).alias("strength"), first["ts"].alias("first_bar_ts"),
            )
            rows.append(F.when(matches(shape, side) & met if named else matches(shape, side), fields))
    flat = recent(g, max(s.bars for s in shapes)).select("symbol", "ts", F.explode(F.array_compact(F.array(*rows))).alias("r"))
    return flat.select("symbol", "ts", "r.*")
