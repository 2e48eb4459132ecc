"""Labels of bars from what follows them, the weights of labels that overlap, and training rows clear of test windows.

Later bars serve here as targets only. Labels end at fixed horizons; bars whose horizon has a gap or leaves the data have none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.functions.scans import haloed
from tidemark.functions.semantics import by

BAR_SECONDS = 300
#: Bars that one task labels at a time.
BLOCK = 4096
#: Bars of a node's children in the pyramids of highs and lows, and how many levels they have above the bars.
FAN, LEVELS = 4, 3


@dataclass(frozen=True)
class Barriers:
    """Stop at stop_atr ATR (at least where the smallest commission stays within max_fee_risk of the risk at full size), target at reward times that,
    time after horizon bars. Size by risk and capital in steps; commission and financing in basis points a side and a night."""

    horizon: int = 96
    stop_atr: float = 2.0
    reward: float = 2.0
    capital: float = 10_000.0
    risk_percent: float = 0.1
    max_units: float = 5_000.0
    unit_step: float = 1_000.0
    commission: float = 0.2
    least_commission: float = 2.0
    financing: float = 0.5
    max_fee_risk: float = 0.45


class Pyramid:
    """Highest best and lowest worst price of aligned stretches of bars: level k holds stretches of FAN^k."""

    def __init__(self, worst: np.ndarray, best: np.ndarray):
        self.worst, self.best = [worst], [best]
        for _ in range(LEVELS):
            pad = -len(self.worst[-1]) % FAN
            self.worst.append(np.pad(self.worst[-1], (0, pad), constant_values=np.inf).reshape(-1, FAN).min(axis=1))
            self.best.append(np.pad(self.best[-1], (0, pad), constant_values=-np.inf).reshape(-1, FAN).max(axis=1))
        #: nodes read for the last search's labels
        self.read = np.zeros(0, np.int64)

    def first(self, start: np.ndarray, end: np.ndarray, stop: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """For each label the first bar of start <= bar < end whose worst price is at most stop or whose best is at least goal, else -1. From the start each
        label reads the largest stretch that begins there and ends in time; where that touches a barrier, its parts, else what follows."""
        out = np.full(len(start), -1, np.int64)
        self.read = np.zeros(len(start), np.int64)
        at, level = start.astype(np.int64).copy(), np.full(len(start), LEVELS)
        live = np.flatnonzero(at < end)
        sizes = FAN ** np.arange(LEVELS + 1)
        while len(live):
            # down to a stretch that is aligned and within the horizon
            k = level[live]
            for step in range(LEVELS, 0, -1):
                size = sizes[step]
                k = np.where((k == step) & ((at[live] % size != 0) | (at[live] + size > end[live])), step - 1, k)
            touched = np.zeros(len(live), bool)
            for step in range(LEVELS + 1):
                mine = np.flatnonzero(k == step)
                node = at[live[mine]] // sizes[step]
                touched[mine] = (self.worst[step][node] <= stop[live[mine]]) | (self.best[step][node] >= goal[live[mine]])
            self.read[live] += 1
            out[live[touched & (k == 0)]] = at[live[touched & (k == 0)]]
            level[live] = np.where(touched, k - 1, LEVELS)
            at[live[~touched]] += sizes[k[~touched]]
            live = live[(level[live] >= 0) & (at[live] < end[live])]
        return out


def barrier_labels(bars: DataFrame, direction: int = -1, rules: Barriers = Barriers(), block: int = BLOCK) -> DataFrame:
    """symbol, ts, label_end, reason, bars, net_r of bars (symbol, ts, bid_* and ask_* prices, atr): what a position opened at the next bar's open would have
    brought, in units of its risk and after costs. Opening gaps come before touches within a bar, and the stop before the target. label_end is the end
    of the whole horizon. net_r is null without a whole horizon of adjacent bars, or where the size or the fee forbids the position."""
    d, h = float(direction), rules.horizon
    sides = ("bid", "ask") if d < 0 else ("ask", "bid")  # entry, exit
    floor = 2 * rules.least_commission / rules.max_fee_risk / rules.max_units
    placed = bars.withColumn("__i", F.row_number().over(by()) - 1).select(
        "symbol", "ts", F.col("__i").cast("long").alias("__i"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("__at"), F.unix_date(calendar.trading_day(F.col("ts"))).alias("__day"),
        F.col(f"{sides[0]}_open").cast("double").alias("__entry"), *[F.col(f"{sides[1]}_{c}").cast("double").alias(f"__{c}") for c in ("open", "high", "low", "close")], F.col("atr").cast("double").alias("__atr"),
    )

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("__i")
        x = {c: group.column(c).to_numpy().astype(float if c in ("__entry", "__open", "__high", "__low", "__close", "__atr") else np.int64) for c in group.column_names if c not in ("symbol", "ts", "__own", "__block")}
        own = np.flatnonzero(group.column("__own").to_numpy(zero_copy_only=False))
        n = len(x["__at"])
        opened, closed = d * x["__open"], d * x["__close"]
        worst, best = (d * x["__low"], d * x["__high"]) if d > 0 else (d * x["__high"], d * x["__low"])
        last = np.minimum(own + h, n - 1)
        whole = (own + h < n) & (x["__at"][last] - x["__at"][own] == h * BAR_SECONDS)
        entry = d * x["__entry"][np.minimum(own + 1, n - 1)]
        with np.errstate(invalid="ignore", divide="ignore"):
            risk = np.maximum(rules.stop_atr * x["__atr"][own], floor)
            units = np.floor(np.minimum(rules.capital * rules.risk_percent / 100 / risk, rules.max_units) / rules.unit_step) * rules.unit_step
            paid = d * entry
            fee = np.maximum(rules.least_commission, rules.commission * 1e-4 * units * paid)
            valid = whole & np.isfinite(risk) & (units >= rules.unit_step) & (2 * fee / np.maximum(units * risk, 1e-12) <= rules.max_fee_risk + 1e-9)
        stop, goal = entry - risk, entry + rules.reward * risk
        chosen = np.flatnonzero(valid)
        pyramid = Pyramid(np.where(np.isnan(worst), np.inf, worst), np.where(np.isnan(best), -np.inf, best))
        found = pyramid.first(own[chosen] + 1, own[chosen] + 1 + h, stop[chosen], goal[chosen])
        exits = np.where(found < 0, own[chosen] + h, found)
        s, g = stop[chosen], goal[chosen]
        cases = [opened[exits] <= s, opened[exits] >= g, worst[exits] <= s, best[exits] >= g]
        price = np.select(cases, [opened[exits], opened[exits], s, g], closed[exits])
        named = np.select(cases, ["stop_gap", "target_gap", "stop", "target"], "time")
        u, r, p = units[chosen], risk[chosen], paid[chosen]
        cost = fee[chosen] + np.maximum(rules.least_commission, rules.commission * 1e-4 * u * (d * price))
        cost += np.maximum(0, x["__day"][exits] - x["__day"][own[chosen] + 1]) * rules.financing * 1e-4 * u * p
        net, reason, age = np.full(len(own), np.nan), np.full(len(own), None, object), np.full(len(own), np.nan)
        net[chosen], reason[chosen], age[chosen] = (price - entry[chosen]) / r - cost / (u * r), named, exits - own[chosen]
        mine = group.take(pa.array(own))
        ends = pa.array(np.where(own + h < n, x["__at"][last] + BAR_SECONDS, 0), pa.int64(), mask=own + h >= n)
        return pa.table({"symbol": mine.column("symbol"), "ts": mine.column("ts"), "__end": ends, "reason": pa.array(reason.tolist(), pa.string()), "bars": pa.array(age, pa.int32(), mask=np.isnan(age), safe=False), "net_r": pa.array(net, pa.float64(), from_pandas=True)})

    kind = bars.schema["ts"].dataType.simpleString()
    out = haloed(placed, "__i", max(block, h + 1), after=h + 1).groupBy("symbol", "__block").applyInArrow(run, f"symbol string, ts {kind}, __end long, reason string, bars int, net_r double")
    return out.select("symbol", "ts", F.timestamp_seconds("__end").cast(kind).alias("label_end"), "reason", "bars", "net_r")


def economic(bars: DataFrame, rules: Barriers = Barriers()) -> DataFrame:
    """symbol, ts and what a position would cost by prices known at the bar (bid_close, ask_close, atr): fee_r and spread_r in its risk, floor_ratio (the stop by ATR over the least stop) and units_share of the largest size.
    Null without an ATR; a size of 0 has a fee beyond all bounds."""
    floor = 2 * rules.least_commission / rules.max_fee_risk / rules.max_units
    stop = F.greatest(rules.stop_atr * F.col("atr"), F.lit(floor)) + 0 * F.col("atr")
    units = F.when(stop.isNotNull(), F.floor(F.least(rules.capital * rules.risk_percent / 100 / stop, F.lit(rules.max_units)) / rules.unit_step) * rules.unit_step)
    fee = 2 * F.greatest(F.lit(rules.least_commission), rules.commission * 1e-4 * units * F.col("ask_close"))
    return bars.select("symbol", "ts", F.when(stop.isNotNull(), fee / F.greatest(units * stop, F.lit(1e-12))).alias("fee_r"), ((F.col("ask_close") - F.col("bid_close")) / stop).alias("spread_r"), (rules.stop_atr * F.col("atr") / floor).alias("floor_ratio"), (units / rules.max_units).alias("units_share"))


def forward_rows(bars: DataFrame, horizon: int = 96, limit: float = 20.0) -> DataFrame:
    """symbol, ts, label_end and target of bars (symbol, ts, open, close, atr): the move from the next open to the close horizon bars later in ATRs, within
    +-limit; null without a whole horizon of adjacent bars or a positive ATR."""
    w = by()
    end = F.lead("ts", horizon).over(w)
    adjacent = F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")) == horizon * BAR_SECONDS
    move = (F.lead("close", horizon).over(w) - F.lead("open").over(w)) / F.when(F.col("atr") > 0, F.col("atr"))
    target = F.when(adjacent, F.greatest(F.lit(-limit), F.least(F.lit(limit), move)) + 0 * move)
    return bars.select("symbol", "ts", (end + F.expr(f"interval {BAR_SECONDS} seconds")).alias("label_end"), target.alias("target"))


def uniqueness(bars: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (symbol, ts, label_end, weight) with uniqueness, the mean over a label's bars of one by the number of labels that cover the bar, and weight times that by the
    mean uniqueness of all labels. bars (symbol, ts) count once each; a label covers the bars of ts <= bar < label_end, its own at least.

    Labels add one where they begin and take one where they end; running sums along the bars give the labels that cover each bar and the sum of inverses up to it. A
    label's mean is then the difference of two looked-up sums.
    """
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    marks = labels.select("symbol", F.explode(F.array(F.struct("ts", F.lit(1).alias("change")), F.struct(F.col("label_end").alias("ts"), F.lit(-1).alias("change")))).alias("m")).select("symbol", "m.*")
    points = bars.select("symbol", "ts", F.lit(0).alias("change"), F.lit(1).alias("bar")).unionByName(marks.withColumn("bar", F.lit(0)))
    line = points.groupBy("symbol", "ts").agg(F.sum("change").alias("change"), F.max("bar").alias("bar"))
    line = line.withColumn("covering", F.sum("change").over(w))
    inverse = F.when((F.col("bar") == 1) & (F.col("covering") > 0), 1.0 / F.col("covering")).otherwise(0.0)
    line = line.withColumns({"__inverse": inverse}).withColumns({"sum_before": F.sum("__inverse").over(w) - F.col("__inverse"), "bars_before": F.sum("bar").over(w) - F.col("bar")})
    at = lambda time, name: line.select(F.col("symbol"), F.col("ts").alias(time), F.col("sum_before").alias(f"__sum_{name}"), F.col("bars_before").alias(f"__bars_{name}"))
    met = labels.join(at("ts", "begin"), ["symbol", "ts"]).join(at("label_end", "end"), ["symbol", "label_end"])
    out = met.withColumn("uniqueness", (F.col("__sum_end") - F.col("__sum_begin")) / (F.col("__bars_end") - F.col("__bars_begin")))
    mean = out.agg(F.avg("uniqueness").alias("__mean"))
    return out.join(F.broadcast(mean)).select("symbol", "ts", "label_end", "uniqueness", (F.col("weight") * F.col("uniqueness") / F.col("__mean")).alias("weight"))


def purged(rows: DataFrame, begin: Column, before: Column, embargo_hours: float = 24.0) -> Column:
    """Whether a row (ts, label_end, target) may train for a test that begins at before: known, from begin on, and its label over by the embargo."""
    cutoff = before - F.expr(f"interval {int(embargo_hours * 3600)} seconds")
    return F.coalesce((F.col("ts") >= begin) & (F.col("label_end") < cutoff) & F.col("target").isNotNull(), F.lit(False))


def clear_of(rows: DataFrame, windows: DataFrame, embargo_hours: float = 24.0, bin_hours: int = 24) -> DataFrame:
    """Pairs of rows (with ts, label_end) and windows (window, begin, end) where the row's label stays clear of the window and of the embargo around it: what may train
    for each window. Rows meet the windows' bins that they touch, which is an equi join; the pairs that overlap are left out of all pairs of rows and
    windows, of which there are as many as rows times windows and no fewer, being the result. windows is a short list."""
    embargo = F.expr(f"interval {int(embargo_hours * 3600)} seconds")
    number = lambda t: F.floor(F.unix_seconds(t.cast("timestamp")) / (bin_hours * 3600))
    bins = lambda a, z: F.explode(F.sequence(number(a), number(z)))
    wide = windows.select("window", (F.col("begin") - embargo).alias("__a"), (F.col("end") + embargo).alias("__z"))
    touched = rows.select("symbol", "ts", "label_end", bins(F.col("ts"), F.col("label_end")).alias("__bin")).join(wide.withColumn("__bin", bins(F.col("__a"), F.col("__z"))), "__bin")
    overlap = touched.where((F.col("ts") < F.col("__z")) & (F.col("label_end") > F.col("__a"))).select("symbol", "ts", "window").distinct()
    dealt = rows.join(F.broadcast(windows.agg(F.collect_list("window").alias("__windows")))).withColumn("window", F.explode("__windows")).drop("__windows")
    return dealt.join(overlap, ["symbol", "ts", "window"], "left_anti")
