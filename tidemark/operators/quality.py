"""Data-quality rules of provider bars: which rule first excludes a row, which flags it carries, and every finding as a row.

Nothing is dropped silently: accept() keeps the rows that no rule excludes, issues() has a row for each finding with the action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.semantics import by, lagged

PRICES = ("open", "high", "low", "close")
#: Returns, gaps and falls of the adjustment factor that are flagged, tolerance of the price order.
RETURN, GAP, FACTOR, TOLERANCE = 0.10, 0.07, 1e-4, 1e-6


def exclusions(as_of: Column) -> list[tuple[str, Column]]:
    """Rules in order; the first that holds names the row."""
    inf = F.lit(float("inf"))
    present = [F.col(c).isNull() for c in (*PRICES, "volume")]
    null = present[0]
    for p in present[1:]:
        null = null | p
    infinite = F.lit(False)
    for c in (*PRICES, "volume", "adj_close"):
        infinite = infinite | F.coalesce(F.abs(F.col(c)) == inf, F.lit(False)) | F.coalesce(F.isnan(c), F.lit(False))
    o, h, lo, c = (F.col(x) for x in PRICES)
    return [
        ("null_value", null),
        ("non_finite_value", infinite),
        ("non_positive_price", F.least(*PRICES) <= 0),
        ("non_positive_adj_close", F.coalesce(F.col("adj_close") <= 0, F.lit(False))),
        ("ohlc_inconsistent", (h + TOLERANCE < F.greatest(o, c, lo)) | (lo - TOLERANCE > F.least(o, c, h))),
        ("negative_volume", F.col("volume") < 0),
        ("future_bar", F.col("ts") > as_of),
    ]


def duplicates(rows: DataFrame) -> DataFrame:
    """Adds duplicate: 'duplicate_bar' on all but one of identical rows of a key, 'conflicting_duplicate_bar' on all rows of a key
    whose values differ."""
    key, values = Window.partitionBy("symbol", "ts"), F.struct(*PRICES, "volume", "adj_close")
    same = F.min(values).over(key).eqNullSafe(F.max(values).over(key))
    place = F.row_number().over(key.orderBy(*PRICES, "volume", "adj_close"))
    return rows.withColumn("duplicate", F.when(~same, "conflicting_duplicate_bar").when(place > 1, "duplicate_bar"))


def validate(rows: DataFrame, as_of: Column) -> DataFrame:
    """Adds rule (the first that excludes the row, or null)."""
    marked = duplicates(rows)
    rule = F.when(F.col("duplicate").isNotNull(), F.col("duplicate"))
    for name, holds in exclusions(as_of):
        rule = rule.when(F.coalesce(holds, F.lit(False)), name)
    return marked.withColumn("rule", rule).drop("duplicate")


def accept(validated: DataFrame) -> DataFrame:
    return validated.where("rule is null").drop("rule")


def flags(bars: DataFrame) -> DataFrame:
    """Findings on accepted bars that exclude nothing: symbol, ts, check, value. Splits are found where bars have split_ratio."""
    before, w = lagged("close"), by()
    factor = F.col("adj_close") / F.col("close")
    moved, gap, fell = F.col("close") / before - 1, F.col("open") / before - 1, factor / F.lag(factor).over(w) - 1
    found = [
        ("zero_volume", F.col("volume") == 0, F.col("volume")),
        ("missing_adj_close", F.col("adj_close").isNull(), F.lit(None).cast("double")),
        ("split_detected", F.col("split_ratio") != 0 if "split_ratio" in bars.columns else F.lit(False), F.col("split_ratio") if "split_ratio" in bars.columns else F.lit(None).cast("double")),
        ("return_outlier", F.abs(moved) > RETURN, moved),
        ("gap_outlier", F.abs(gap) > GAP, gap),
        ("adj_factor_decrease", fell < -FACTOR, fell),
    ]
    each = F.array(*[F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("check"), value.alias("value"))) for name, holds, value in found])
    listed = bars.withColumn("__each", each).select("symbol", "ts", F.filter("__each", lambda x: x.isNotNull()).alias("__found"))
    return listed.select("symbol", "ts", F.explode("__found").alias("f")).select("symbol", "ts", "f.*")


def gaps(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Stretches of sessions of the calendar between two neighbouring bars of an instrument: symbol, first (missing session), n (how many are missing) and
    place (of the first, counted from 1). Only the calendar is numbered as a whole; bars, which may repeat, are shuffled once and never multiplied by sessions."""
    times = calendar.select("ts", F.lit(1).alias("open")).unionByName(bars.select("ts", F.lit(0).alias("open"))).where("ts is not null").groupBy("ts").agg(F.max("open").alias("open"))
    line = Window.orderBy("ts")
    upto = F.sum("open").over(line.rowsBetween(Window.unboundedPreceding, 0))
    following = F.last(F.when(F.col("open") == 1, F.col("ts")), ignorenulls=True).over(Window.orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1))
    times = times.select("ts", upto.alias("upto"), (upto - F.col("open")).alias("before"), following.alias("first"))
    pairs = bars.select("symbol", "ts", F.lead("ts").over(by()).alias("next"))
    open_ended = pairs.join(F.broadcast(times.select("ts", "upto", "first")), "ts").where(F.col("first") < F.col("next"))
    met = open_ended.join(F.broadcast(times.select(F.col("ts").alias("next"), "before")), "next")
    return met.select("symbol", "first", (F.col("before") - F.col("upto")).alias("n"), (F.col("upto") + 1).alias("place"))


def missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sessions of the calendar between an instrument's first and last bar without a bar of it."""
    numbered = calendar.select("ts").where("ts is not null").distinct().select("ts", F.row_number().over(Window.orderBy("ts")).cast("long").alias("place"))
    each = gaps(bars, calendar).select("symbol", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("n") - 1)).alias("place"))
    return each.join(F.broadcast(numbered), "place").select("symbol", "ts")


def revisions(stored: DataFrame, incoming: DataFrame, noise: float = 1e-5) -> DataFrame:
    """Each key of either side: inserted, unchanged, adj_close_restated, revised or kept (absent from incoming). Differences of
    adj_close within the relative noise are none."""
    columns = (*PRICES, "volume", "adj_close")
    s, i = stored.select("symbol", "ts", F.struct(*columns).alias("old")), incoming.select("symbol", "ts", F.struct(*columns).alias("new"))
    both = s.join(i, ["symbol", "ts"], "full_outer")
    changed = F.lit(False)
    for c in (*PRICES, "volume"):
        changed = changed | ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    old, new = F.col("old.adj_close"), F.col("new.adj_close")
    adjusted = F.when(old.isNull() | new.isNull(), ~old.eqNullSafe(new)).otherwise(F.abs(new / old - 1) > noise)
    kind = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "kept").when(changed, "revised").when(adjusted, "adj_close_restated").otherwise("unchanged")
    return both.select("symbol", "ts", kind.alias("outcome"))
