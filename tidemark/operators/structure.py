"""Swings, their labels, consolidation ranges and structure, from each instrument's highs and lows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import by, following, full, lagged, positive_ratio, prior, prior_mean, running, trailing


@dataclass(frozen=True)
class StructureConfig:
    """Fixed values."""

    left: int = 5
    right: int = 5
    equal: float = 0.001
    labels: int = 2
    quality_labels: int = 6
    window: int = 20
    max_width: float = 0.05
    lookback: int = 20
    expansion: float = 1.5
    contraction: float = 0.5


CONFIG = StructureConfig()


def pivots(bars: DataFrame, cfg: StructureConfig = CONFIG) -> DataFrame:
    """symbol, ts, idx, kind, price, confirmed_at, confirmed_idx: extremes beyond all of the bars before and not passed by the bars
    after, once those have closed. The forward frame only decides what becomes known at confirmed_at."""
    w = by()
    rows = bars.select(
        "symbol", "ts", "high", "low", (F.row_number().over(w) - 1).cast("long").alias("idx"), F.lead("ts", cfg.right).over(w).alias("confirmed_at"),
        full(F.max("high"), F.col("high"), prior(cfg.left), cfg.left).alias("hl"), full(F.max("high"), F.col("high"), following(cfg.right), cfg.right).alias("hr"),
        full(F.min("low"), F.col("low"), prior(cfg.left), cfg.left).alias("ll"), full(F.min("low"), F.col("low"), following(cfg.right), cfg.right).alias("lr"),
    )
    high = F.when((F.col("high") > F.col("hl")) & (F.col("high") >= F.col("hr")), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price")))
    low = F.when((F.col("low") < F.col("ll")) & (F.col("low") <= F.col("lr")), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price")))
    both = rows.select("symbol", "ts", "idx", "confirmed_at", F.explode(F.filter(F.array(high, low), lambda p: p.isNotNull())).alias("p"))
    return both.select("symbol", "ts", "idx", F.col("p.kind").alias("kind"), F.col("p.price").alias("price"), "confirmed_at", (F.col("idx") + cfg.right).alias("confirmed_idx"))


def swings(bars: DataFrame, cfg: StructureConfig = CONFIG) -> DataFrame:
    """Pivots with change_pct from the previous pivot of their kind, its label, and swing_id by (confirmed, pivot, kind)."""
    change = F.round(F.col("price") / F.lag("price").over(by("symbol", "kind", ts="idx")) - 1, 10)
    labelled = pivots(bars, cfg).withColumn("change_pct", change)
    up, down = F.when(F.col("kind") == "high", "HH").otherwise("HL"), F.when(F.col("kind") == "high", "LH").otherwise("LL")
    label = F.when(F.col("change_pct") > cfg.equal, up).when(F.col("change_pct") < -cfg.equal, down).when(F.col("change_pct").isNotNull(), F.when(F.col("kind") == "high", "EH").otherwise("EL"))
    order = Window.partitionBy("symbol").orderBy("confirmed_idx", "idx", "kind")
    return labelled.withColumn("label", label).withColumn("swing_id", (F.row_number().over(order) - 1).cast("long"))


def structure(bars: DataFrame, cfg: StructureConfig = CONFIG) -> DataFrame:
    """symbol, ts, structure, trend, trend_quality, trend_evidence, last labels and prices: what confirmed swings say at each bar.

    The last labels of either kind are kept as arrays at each swing and carried to the bars from its confirmation on.
    """
    s = swings(bars, cfg).where("label is not null").select("symbol", "kind", "label", "price", "confirmed_at", "swing_id")
    recent = Window.partitionBy("symbol").orderBy("swing_id").rowsBetween(Window.unboundedPreceding, 0)
    near = Window.partitionBy("symbol").orderBy("swing_id").rowsBetween(-(cfg.quality_labels - 1), 0)
    # rank within kind gives each swing its predecessors of that kind without growing lists
    kinds = Window.partitionBy("symbol", "kind").orderBy("swing_id")
    s = s.withColumn("of_kind", F.array_compact(F.array(*[F.lag("label", k).over(kinds) for k in reversed(range(1, cfg.labels))], F.col("label"))))
    for kind in ("high", "low"):
        s = s.withColumn(f"{kind}s", F.last(F.when(F.col("kind") == kind, F.col("of_kind")), ignorenulls=True).over(recent))
    s = s.withColumn("evidence", F.collect_list("label").over(near))
    at = s.groupBy("symbol", F.col("confirmed_at").alias("ts")).agg(F.max_by(F.struct("highs", "lows", "evidence"), "swing_id").alias("known"))
    prices = swings(bars, cfg).groupBy("symbol", F.col("confirmed_at").alias("ts")).agg(
        F.max_by("price", F.when(F.col("kind") == "high", F.col("swing_id"))).alias("high_price"), F.max_by("price", F.when(F.col("kind") == "low", F.col("swing_id"))).alias("low_price")
    )
    known = bars.select("symbol", "ts").join(at, ["symbol", "ts"], "left").join(prices, ["symbol", "ts"], "left")
    known = known.select("symbol", "ts", *[F.last(c, ignorenulls=True).over(running()).alias(c) for c in ("known", "high_price", "low_price")])
    highs, lows = F.coalesce(F.col("known.highs"), F.array().cast("array<string>")), F.coalesce(F.col("known.lows"), F.array().cast("array<string>"))
    only = lambda labels, allowed: F.size(F.array_except(labels, F.array(*map(F.lit, allowed)))) == 0
    shape = (
        F.when((F.size(highs) < cfg.labels) | (F.size(lows) < cfg.labels), "insufficient_data")
        .when(only(highs, ["HH"]) & only(lows, ["HL"]), "uptrend")
        .when(only(highs, ["LH"]) & only(lows, ["LL"]), "downtrend")
        .when(only(highs, ["LH", "EH"]) & only(lows, ["HL", "EL"]), "range")
        .otherwise("transition")
    )
    trend = F.create_map(*[F.lit(x) for x in ("insufficient_data", "insufficient_data", "uptrend", "up", "downtrend", "down", "range", "sideways", "transition", "unclear")])
    evidence = F.col("known.evidence")
    share = lambda good: F.round(F.size(F.filter(evidence, lambda x: x.isin(*good))) / F.size(evidence), 6)
    quality = F.when(F.col("structure") == "uptrend", share(("HH", "HL"))).when(F.col("structure") == "downtrend", share(("LH", "LL"))).when(F.col("structure") == "range", share(("LH", "EH", "HL", "EL")))
    out = known.withColumn("structure", shape)
    return out.select("symbol", "ts", "structure", trend[F.col("structure")].alias("trend"), quality.alias("trend_quality"), F.coalesce(F.array_join(evidence, ","), F.lit("")).alias("trend_evidence"), F.col("high_price").alias("last_swing_high"), F.col("low_price").alias("last_swing_low"))


def size_state(x: Column, cfg: StructureConfig = CONFIG) -> Column:
    return F.when(x >= cfg.expansion, "expansion").when(x <= cfg.contraction, "contraction").when(x.isNotNull(), "normal").otherwise("unknown")


def ranges(bars: DataFrame, cfg: StructureConfig = CONFIG) -> DataFrame:
    """Consolidation episodes (runs of bars whose window is narrow) with their extremes, and how wide candle and window are."""
    n = cfg.window
    df = bars.select("symbol", "ts", "high", "low", "close").withColumns({"window_high": full(F.max("high"), F.col("high"), trailing(n), n), "window_low": full(F.min("low"), F.col("low"), trailing(n), n), "candle": F.col("high") - F.col("low"), "row": F.row_number().over(by())})
    df = df.withColumn("window_width_pct", F.round((F.col("window_high") - F.col("window_low")) / ((F.col("window_high") + F.col("window_low")) / 2), 10))
    df = df.withColumn("in_consolidation", F.coalesce(F.col("window_width_pct") <= cfg.max_width, F.lit(False)))
    began = F.col("in_consolidation") & ~F.coalesce(F.lag("in_consolidation").over(by()), F.lit(False))
    df = df.withColumn("episode", F.sum(began.cast("int")).over(running()))
    inside = Window.partitionBy("symbol", "episode", "in_consolidation").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    held = lambda x: F.when(F.col("in_consolidation"), x)
    df = df.withColumns({"range_high": held(F.max("window_high").over(inside)), "range_low": held(F.min("window_low").over(inside)), "range_bar_count": held(F.count("*").over(inside) + n - 1)})
    ratio_c, before = positive_ratio(F.col("candle"), prior_mean("candle", cfg.lookback)), lagged("window_width_pct", n)
    df = df.withColumns({"range_width_pct": F.round((F.col("range_high") - F.col("range_low")) / ((F.col("range_high") + F.col("range_low")) / 2), 10), "candle_range_ratio": ratio_c, "window_width_ratio": positive_ratio(F.col("window_width_pct"), before), "move": F.col("close") - lagged("close", n)})
    way = F.when(F.col("move") > 0, "up").when(F.col("move") < 0, "down").when(F.col("move").isNotNull(), "flat").otherwise("unknown")
    return df.select("symbol", "ts", "window_high", "window_low", "window_width_pct", "in_consolidation", "range_high", "range_low", "range_bar_count", "range_width_pct", "candle_range_ratio", size_state(F.col("candle_range_ratio"), cfg).alias("candle_range_state"), "window_width_ratio", size_state(F.col("window_width_ratio"), cfg).alias("window_width_state"), way.alias("window_direction"))
