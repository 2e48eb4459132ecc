"""Positions and their cost from fills: netting by instrument, and average cost with partial exits.

Units add up and cost follows an affine map whose factor is known from the units: an increase adds to the cost, a reduction keeps the share that is
left, a close forgets it, a reversal begins anew at the fill's price. Both run in one block scan, so that a long history is no single task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scans import SPAN, composed

#: Decimals of units: below them a position is flat.
UNIT_DECIMALS = 9


def _settled(units: np.ndarray) -> np.ndarray:
    """Units to UNIT_DECIMALS, halves away from zero; beyond what a double resolves they stay."""
    scale = 10.0**UNIT_DECIMALS
    return np.where(np.abs(units) * scale < 2.0**52, np.sign(units) * np.floor(np.abs(units) * scale + 0.5) / scale + 0.0, units)


def _costed(fills: DataFrame, units: Column, rule: Callable[..., list[tuple[np.ndarray, np.ndarray]]], names: tuple[str, ...], reads: tuple[str, ...], keys: tuple[str, ...], order: tuple[str, ...], before: str, span: float) -> DataFrame:
    """fills with units_before, units_after, and the costs names after and (with the prefix before) ahead of each fill; rule(columns, units, before, after) gives their affine maps.
    The units of earlier blocks are sums that Spark adds up, so that one pass over the blocks suffices for both."""

    def steps(x: dict, known: dict) -> tuple[list, dict]:
        with np.errstate(all="ignore"):
            held = np.cumsum(np.r_[known["held"], x["__units"]])
            was, now = _settled(held[:-1]), _settled(held[1:])
            return rule(x, x["__units"], was, now), {"units_before": was, "units_after": now}

    moved = fills.withColumn("__units", units.cast("double")).drop("__signed")
    return composed(moved, names, ("__units", *reads), steps, *keys, order=order, before=before, span=span, totals={"held": F.col("__units")}, more=("units_before", "units_after"))


def netting_book(fills: DataFrame, *keys: str, order: tuple[str, ...] = ("ts",), rate: str | None = None, span: float = SPAN) -> DataFrame:
    """fills (keys, order columns, units signed, price, commission) with units_before, units_after, action (OPEN, INCREASE, REDUCE, CLOSE, REVERSE), avg_price after
    the fill (null when flat), realized (of the part closed, in the account's currency by the column rate) and cash (realized less commission). A fill of
    no units changes nothing (NONE); one with an unknown price leaves the cost unknown until the book is flat or reversed."""

    def rule(x, units, was, now):
        change = was * units
        grows = (was == 0) | ((change >= 0) & (units != 0))
        reduces, turns = (change < 0) & (was * now > 0), ~grows & (units != 0) & (now != 0) & ~(was * now > 0)
        kept = np.select([units == 0, was == 0, change >= 0, now == 0, reduces], [1.0, 0.0, 1.0, 0.0, now / was], 0.0)
        return [(kept, np.select([units == 0, grows, turns], [0.0, units * x["__price"], now * x["__price"]], 0.0))]

    costed = _costed(fills.withColumn("__price", F.col("price").cast("double")), F.col("units"), rule, ("__cost",), ("__price",), keys, order, "__was", span)
    was, now, units, price = F.col("units_before"), F.col("units_after"), F.col("__units"), F.col("__price")
    against = was * units < 0
    action = F.when(units == 0, "NONE").when(was == 0, "OPEN").when(~against, "INCREASE").when(now == 0, "CLOSE").when(was * now > 0, "REDUCE").otherwise("REVERSE")
    closed = F.when(against, F.least(F.abs(units), F.abs(was))).otherwise(0.0)
    paid = F.try_divide("__was__cost", was)
    gain = F.when(closed == 0, 0.0).otherwise(closed * (price - paid) * F.signum(was)) * (F.col(rate) if rate else F.lit(1.0))
    out = costed.withColumns({"action": action, "avg_price": F.when(now != 0, F.col("__cost") / now), "realized": gain})
    cash = F.col("realized") - (F.coalesce(F.col("commission").cast("double"), F.lit(0.0)) if "commission" in fills.columns else F.lit(0.0))
    return out.withColumn("cash", cash).drop("__units", "__price", "__cost", "__was__cost")


def average_cost(fills: DataFrame, *keys: str, order: tuple[str, ...] = ("ts",), span: float = SPAN) -> DataFrame:
    """fills (keys, order columns, side BUY or SELL, shares, notional, costs) of a book that is never short, with shares_after, action (ENTRY, ADD,
    REDUCE, EXIT), basis_notional and basis_costs after the fill, and realized: what a sale brings less its share of both and less its own costs.
    A sale of more than is held is SHORT: an exit of what is held, after which the book is flat by no rule and its numbers are null until it holds shares again."""
    buy = F.col("side") == "BUY"

    def rule(x, units, was, now):
        buys, short = x["__buy"] == 1.0, np.fmin(was, now) < 0
        grows, leaves = buys & ~short, ~buys & ~short & (now == 0)
        kept = np.select([short, grows & (was == 0), grows, leaves], [np.nan, 0.0, 1.0, 0.0], now / was)
        return [(kept, np.select([short, grows], [np.nan, x[c]], 0.0)) for c in ("__notional", "__costs")]

    f = fills.withColumns({"__buy": buy, "__notional": F.col("notional").cast("double"), "__costs": F.col("costs").cast("double")})
    f = f.withColumn("__signed", F.when(buy, F.col("shares")).otherwise(-F.col("shares"))).drop("notional", "costs", "shares")
    costed = _costed(f, F.col("__signed"), rule, ("basis_notional", "basis_costs"), ("__buy", "__notional", "__costs"), keys, order, "__was_", span)
    was, now = F.col("units_before"), F.col("units_after")
    short = F.least(was, now) < 0
    action = F.when(short, "SHORT").when(buy & (was == 0), "ENTRY").when(buy, "ADD").when(now == 0, "EXIT").otherwise("REDUCE")
    out = costed.withColumns({"action": action, "shares": F.when(buy, F.col("__units")).otherwise(-F.col("__units")), "notional": F.col("__notional"), "costs": F.col("__costs")})
    sold = lambda c: F.col(f"__was_{c}") - F.col(c)
    gain = F.when(F.col("action").isin("REDUCE", "EXIT"), F.col("notional") - sold("basis_notional") - sold("basis_costs") - F.col("costs")).when(F.col("action") != "SHORT", 0.0)
    return out.withColumns({"realized": gain, "shares_after": now}).drop("__buy", "__units", "units_before", "units_after", "__notional", "__costs", "__was_basis_notional", "__was_basis_costs")
