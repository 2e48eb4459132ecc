"""Scalar rules: scores of shapes, ids and canonical texts, prices that fit a budget, times in several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) + 0 * x


def at_least(x: Column, threshold: float, ideal: float) -> Column:
    """0 at the threshold, 1 at a larger ideal, in proportion between."""
    return clipped((x - threshold) / (ideal - threshold))


def at_most(x: Column, threshold: float, ideal: float) -> Column:
    """0 at the threshold, 1 at a smaller ideal, in proportion between."""
    return clipped((threshold - x) / (threshold - ideal))


def log_score(x: Column, ideal: float) -> Column:
    """0 at 1, 1 at the ideal, by logarithms; null unless x is positive."""
    return clipped(F.ln(F.when(x > 0, x)) / F.ln(F.lit(ideal)))


def mean_of(*parts: Column) -> Column:
    """Mean of the parts that are defined, null where none is."""
    known = F.filter(F.array(*parts), lambda v: v.isNotNull() & ~F.isnan(v))
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known))


def canonical(values: dict[str, Column]) -> Column:
    """JSON of texts, whole numbers and truth values with sorted keys and no spaces; nulls are written, NaN is null."""
    cleaned = [F.coalesce(F.to_json(F.struct(c.alias(k))), F.lit("{}")) for k, c in sorted(values.items())]
    parts = [F.when(text == "{}", F.lit(f'"{k}":null')).otherwise(F.substring(text, 2, 1 << 30)) for (k, _), text in zip(sorted(values.items()), cleaned, strict=True)]
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.regexp_replace(p, r"\}$", "") for p in parts]), F.lit("}"))


def fingerprint_of(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def commission(notional: Column, rate: float, least: float, most: float) -> Column:
    return F.when(notional.isNotNull(), F.least(F.lit(most), F.greatest(F.lit(least), notional * rate)))


def limit_price(budget: Column, quantity: Column) -> Column:
    """The largest price in hundredths at which the quantity stays within the budget, in decimals."""
    exact = budget.cast("decimal(20,4)") / F.when(quantity > 0, quantity).cast("decimal(12,0)")
    return (F.floor(exact * 100) / 100).cast("decimal(20,2)")


def target_weight(assets: int, target: float, volatility: Column) -> Column:
    """An equal share, less where the volatility exceeds its target; null without a volatility."""
    return F.when(volatility > 0, F.least(F.lit(1.0), target / volatility) / assets)


def state_of(probability: Column) -> Column:
    return F.when(probability.isNull() | F.isnan(probability), "INSUFFICIENT_DATA").when(probability > 0.5, "LONG").otherwise("FLAT")


def iso_time(text: Column) -> Column:
    """A time in ISO notation with or without fractions of a second, with T or a space, with Z, an offset or neither (UTC); null where it is none."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(F.regexp_replace(zoned, "^(\\d{4}-\\d\\d-\\d\\d) ", "$1T"))


def without_nan(x: Column) -> Column:
    return F.nanvl(x, F.lit(None).cast("double"))
