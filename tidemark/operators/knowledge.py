"""Further shapes of two and three candles, written like those of candles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators.candles import STAR, Shape, observations

_HELD = "x1.loses AND x1.body >= 0.5 AND greatest(x0.start, x0.end) < greatest(x1.start, x1.end) AND least(x0.start, x0.end) > least(x1.start, x1.end)"

#: The shapes, with fixed values for their names and thresholds.
MORE_SHAPES = (
    Shape("reversal", 2, f"{_HELD} AND x0.gains AND x0.body <= 0.3 AND x0.body > 0.1", (), "bullish_harami", "bearish_harami"),
    Shape("reversal", 2, f"{_HELD} AND x0.body <= 0.1", (), "bullish_harami_cross", "bearish_harami_cross"),
    Shape(
        "reversal", 2,
        "x1.loses AND x0.gains AND x1.body >= 0.5 AND x0.body >= 0.5 AND x0.start < x1.pit AND x0.end > (x1.start + x1.end) / 2 AND x0.end < x1.start",
        (), "piercing_line", "dark_cloud_cover",
    ),
    Shape("indecision", 1, "x0.body <= 0.1 AND x0.tail >= 0.6 AND x0.nose <= 0.1", (), "dragonfly_doji", "gravestone_doji"),
    Shape("reversal", 3, f"{STAR} AND x1.body <= 0.1", (), "morning_doji_star", "evening_doji_star"),
)


def recognised(g: DataFrame) -> DataFrame:
    """symbol, ts, pattern: a row for each of these shapes that a bar of the geometry completes."""
    return observations(g, MORE_SHAPES).select("symbol", "ts", "pattern")
