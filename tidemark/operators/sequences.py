"""Ordered patterns: a sweep of a reference range's high, a break of structure, and a retest of the retracement zone, each within so many bars.

What a sequence does is decided by the bars from its sweep on, so that each candidate is followed on its own, over a bounded number of bars, in blocks that
hold the bars after them as well. Which candidates begin one, as long as a sequence runs no other begins, is a choice of intervals one after the other
(scans.taken), whose blocks are summed up as tables of entry states. No symbol is one fold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scans import haloed, taken
from tidemark.functions.semantics import by, full, prior
from tidemark.sources.bars import bucket_start

#: The retracement zone, as parts of the way from the base up to the origin (fixed values).
ZONE = (0.62, 0.79)
#: Bars that one task follows candidates in.
BLOCK = 4096


@dataclass(frozen=True)
class Course:
    """How a sequence runs: it expires more than horizon bars after its sweep. settle: bars that the lowest low must stand before a retest counts, until which a
    new low only lowers the base (0: a new low ends the sequence). floored: whether touching the reference's low ends it."""

    horizon: int
    settle: int = 0
    floored: bool = False


FAST = Course(12)
SESSION = Course(36, 2, True)
ENDS = ("gap", "expired", "origin", "floor", "new_low", "retest", "passed", "session", "open")


def follow(x: dict[str, np.ndarray], s: int, course: Course) -> dict:
    """The sequence of the sweep at place s of a block's bars: where and how it ends, and its anchors then. "retest" is the one that counts: the first bar that
    comes up to the zone closes below it, falling, above the reference's low, and does not come out above the zone. The others: a gap before the bar, expiry, a high at
    the sweep's high, the reference's low touched, a new low, a first retest that fails (passed), the session's end, the end of the data."""
    high, low, opened, closed, floor = x["high"], x["low"], x["open"], x["close"], x["floor"][s]
    origin, base, level = high[s], low[s], x["structure"][s]
    broke = lowest = -1
    settled, gap_seen, displaced = course.settle == 0, False, False
    n = len(high)
    j, end = s, "open"
    while j + 1 < n:
        j += 1
        if x["session"][j] != x["session"][s]:
            end = "session"
        elif x["gap"][j]:
            end = "gap"
        elif j - s > course.horizon:
            end = "expired"
        elif high[j] >= origin:
            end = "origin"
        elif course.floored and low[j] <= floor:
            end = "floor"
        elif broke < 0:
            base = min(base, low[j])
            if closed[j] < level and closed[j] < opened[j]:
                broke = lowest = j
                displaced = bool(opened[j] - closed[j] >= 1.25 * x["median_body"][j])  # an unknown median displaces nothing
                gap_seen = bool(high[j] < x["low_2"][j])
            continue
        elif low[j] < base and settled:
            end = "new_low"
        else:
            if low[j] < base:
                base, lowest = low[j], j
            settled = settled or j - lowest >= course.settle
            gap_seen = gap_seen or bool(high[j] < x["low_2"][j])
            bottom, top = (base + part * (origin - base) for part in ZONE)
            if not (settled and high[j] >= bottom):
                continue
            end = "retest" if high[j] <= top and closed[j] < bottom and closed[j] < opened[j] and closed[j] > floor else "passed"
        break
    else:
        j = n
    return {"end": j, "outcome": end, "broke": broke, "origin": origin, "base": base, "displaced": displaced, "gap_seen": gap_seen}


def _reference(bars: DataFrame, seconds: int, bars_needed: int) -> DataFrame:
    """symbol, __ref (a bucket's start), and the range of complete buckets: rh, rl, and whether it fell."""
    return (
        bars.groupBy("symbol", bucket_start(F.col("ts"), seconds).alias("__ref"))
        .agg(F.min_by("open", "ts").alias("__o"), F.max_by("close", "ts").alias("__c"), F.max("high").alias("rh"), F.min("low").alias("rl"), F.count("close").alias("__n"))
        .where(F.col("__n") == bars_needed)
        .select("symbol", "__ref", "rh", "rl", (F.col("__c") < F.col("__o")).alias("fell"))
    )


def _placed(bars: DataFrame, minutes: int) -> DataFrame:
    w = by()
    since = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(w).cast("timestamp"))
    return bars.withColumns({"i": (F.row_number().over(w) - 1).cast("long"), "gap": F.coalesce(since != minutes * 60, F.lit(False)), "structure": F.min("low").over(prior(3)), "low_2": F.lag("low", 2).over(w)})


_READS = ("open", "high", "low", "close", "structure", "floor", "low_2", "median_body")


def _followed(bars: DataFrame, course: Course) -> DataFrame:
    """Candidates (where sweep holds) of placed bars with floor, session and median_body, each followed on its own: symbol, i, __end, and what follow() says."""
    kind = bars.schema["ts"].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        x = {c: group.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for c in _READS}
        x["gap"] = group.column("gap").to_numpy(zero_copy_only=False).astype(bool)
        x["session"] = group.column("session").to_numpy()
        place, ts = group.column("i").to_numpy(), group.column("ts")
        mine = np.flatnonzero(group.column("__own").to_numpy(zero_copy_only=False).astype(bool) & group.column("sweep").to_numpy(zero_copy_only=False).astype(bool))
        found = [follow(x, int(s), course) for s in mine]
        at = lambda places: pa.chunked_array([pa.array([ts[p].as_py() if 0 <= p < len(place) else None for p in places], ts.type)])
        out = {"symbol": group.column("symbol").take(pa.array(mine)), "i": pa.array(place[mine]), "swept_at": at(mine.tolist()), "broke_at": at([f["broke"] for f in found]), "ended_at": at([f["end"] for f in found])}
        out["__end"] = pa.array([int(place[0]) + f["end"] for f in found], pa.int64())
        kinds = {"outcome": pa.string(), "origin": pa.float64(), "base": pa.float64(), "displaced": pa.bool_(), "gap_seen": pa.bool_()}
        return pa.table(out | {c: pa.array([f[c] for f in found], t) for c, t in kinds.items()})

    schema = f"symbol string, i long, swept_at {kind}, broke_at {kind}, ended_at {kind}, __end long, outcome string, origin double, base double, displaced boolean, gap_seen boolean"
    reach = course.horizon + 2
    rows = haloed(bars.select("symbol", "ts", "i", "gap", "sweep", F.col("session").cast("long").alias("session"), *_READS), "i", max(BLOCK, reach), before=0, after=reach)
    return rows.groupBy("symbol", "__block").applyInArrow(run, schema)


def _zone(df: DataFrame) -> DataFrame:
    width = F.col("origin") - F.col("base")
    return df.withColumns({"zone_low": F.col("base") + ZONE[0] * width, "zone_high": F.col("base") + ZONE[1] * width})


def sweep_retests(bars: DataFrame, minutes: int = 5, hours: int = 4, course: Course = FAST) -> DataFrame:
    """The sequences of bars (symbol, ts, open, high, low, close) against the whole bucket of hours before: it must have fallen, and the sweep goes above its high,
    closes within it and holds its low. symbol, swept_at, broke_at, ended_at, outcome, origin, base and the zone; outcome "retest" allows a sale at ended_at."""
    placed = _placed(bars, minutes).withColumn("__ref", bucket_start(F.col("ts"), hours * 3600) - F.expr(f"interval {hours} hours"))
    b = placed.join(_reference(bars, hours * 3600, hours * 60 // minutes), ["symbol", "__ref"], "left")
    sweep = (F.col("i") >= 3) & F.col("fell") & (F.col("high") > F.col("rh")) & (F.col("close") > F.col("rl")) & (F.col("close") < F.col("rh")) & (F.col("low") >= F.col("rl"))
    none = F.lit(None).cast("double")
    b = b.withColumns({"sweep": F.coalesce(sweep, F.lit(False)), "floor": F.col("rl"), "session": F.lit(0), "median_body": none})
    chosen = taken(_followed(b, course), "i", "__end", course.horizon + 1, "symbol")
    return _zone(chosen).select("symbol", "swept_at", "broke_at", "ended_at", "outcome", "origin", "base", "zone_low", "zone_high")


#: Sessions: name, hours of the reference range (of the day before where it comes first at midnight), hours of trading; UTC (fixed values).
SESSIONS = (("tokyo", 22, 24, 0, 3), ("london", 0, 8, 8, 11), ("new_york", 8, 13, 13, 17))


def session_setups(bars: DataFrame, course: Course = SESSION) -> DataFrame:
    """The sequences of five-minute bars within the trading hours of a session, against the whole range of its reference hours: as sweep_retests(), and session and the
    strengths reversal, continuation (the market stood below its mean of 20 bars at the sweep) and momentum (the break was 1.25 times the median body of 20 bars, and a gap
    between a bar's low and the high two bars later followed), null where they do not apply."""
    w = by()
    hour, day = F.hour("ts"), F.to_date("ts")
    pick = lambda a, z: [F.when((hour >= s[a]) & (hour < s[z]), F.lit(k)) for k, s in enumerate(SESSIONS)]
    body = F.abs(F.col("close") - F.col("open"))
    placed = _placed(bars, 5).withColumns({"__body": body, "__trades": F.coalesce(*pick(3, 4)), "__refers": F.coalesce(*pick(1, 2)), "__day": day})
    three = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts", 3).over(w).cast("timestamp")) == 900
    placed = placed.withColumns({"__bodies": full(F.collect_list("__body"), F.col("__body"), prior(20), 20), "__mean": full(F.avg("close"), F.col("close"), prior(20), 20), "__close_1": F.lag("close").over(w), "__three": three})
    ordered = F.sort_array("__bodies")
    placed = placed.withColumn("median_body", (ordered[9] + ordered[10]) / 2).drop("__bodies")
    of = F.when(F.col("__refers") == 0, F.date_add("__day", 1)).otherwise(F.col("__day"))
    needed = F.element_at(F.array(*[F.lit((s[2] - s[1]) * 12) for s in SESSIONS]), F.col("__trades") + 1)
    ranges = placed.where("__refers is not null").groupBy("symbol", of.alias("__day"), F.col("__refers").alias("__trades")).agg(F.max("high").alias("rh"), F.min("low").alias("rl"), F.count("*").alias("__n")).where(F.col("__n") == needed)
    b = placed.join(ranges, ["symbol", "__day", "__trades"], "left")
    sweep = (F.col("i") >= 20) & (F.col("high") > F.col("rh")) & (F.col("close") > F.col("rl")) & (F.col("close") < F.col("rh")) & (F.col("low") > F.col("rl")) & F.col("__three")
    number = F.coalesce(F.datediff("__day", F.lit("1970-01-01")) * 4 + F.col("__trades"), F.lit(-1))
    b = b.withColumns({"sweep": F.coalesce(sweep, F.lit(False)), "floor": F.col("rl"), "session": number})
    chosen = taken(_followed(b, course), "i", "__end", course.horizon + 1, "symbol")
    at = b.select("symbol", F.col("ts").alias("ended_at"), (F.col("__body") / F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))).alias("__part"))
    swept = b.where("sweep").select("symbol", F.col("ts").alias("swept_at"), F.element_at(F.array(*[F.lit(s[0]) for s in SESSIONS]), F.col("__trades") + 1).alias("session"), F.coalesce(F.col("__close_1") < F.col("__mean"), F.lit(False)).alias("__aligned"))
    out = _zone(chosen).join(at, ["symbol", "ended_at"], "left").join(swept, ["symbol", "swept_at"])
    strength = F.when(F.col("outcome") == "retest", F.least(F.lit(0.95), 0.5 + 0.4 * F.col("__part")))
    out = out.withColumns({"reversal": strength, "continuation": F.when(F.col("__aligned"), strength), "momentum": F.when(F.col("displaced") & F.col("gap_seen"), strength)})
    return out.select("symbol", "session", "swept_at", "broke_at", "ended_at", "outcome", "origin", "base", "zone_low", "zone_high", "reversal", "continuation", "momentum")


#: Bars that a sweep stays usable, and bars that must be there without a gap for a bar to be judged.
USABLE, CONTEXT = 8, 16


def hourly_veto(bars: DataFrame, minutes: int = 60) -> DataFrame:
    """The hourly bars (symbol, ts, open, high, low, close) at which a sale is ready: within the last USABLE bars a sweep of the whole bucket of four bars before, which fell; the first later
    close below the three lows before the sweep; since then no high at the expansion's high and, before this bar, no new low; and this bar comes up to the zone and closes below it, falling, within
    the reference. Of several sweeps the latest counts. Each bar is judged on its own, after CONTEXT bars without a gap. Other bars have so many minutes."""
    w = by()
    span = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts", CONTEXT - 1).over(w).cast("timestamp"))
    placed = _placed(bars, minutes).withColumns({"__ref": bucket_start(F.col("ts"), 240 * minutes) - F.expr(f"interval {4 * minutes} minutes"), "__whole": F.coalesce(span == (CONTEXT - 1) * 60 * minutes, F.lit(False))})
    b = placed.join(_reference(bars, 240 * minutes, 4), ["symbol", "__ref"], "left")
    sweep = (F.col("i") >= 3) & F.col("fell") & (F.col("high") > F.col("rh")) & (F.col("close") > F.col("rl")) & (F.col("close") < F.col("rh")) & (F.col("low") >= F.col("rl"))
    b = b.withColumn("sweep", F.coalesce(sweep, F.lit(False)))
    kind = bars.schema["ts"].dataType.simpleString()
    numbers = ("open", "high", "low", "close", "structure", "rh", "rl")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        x = {c: group.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for c in numbers}
        own, swept, whole = (group.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("__own", "sweep", "__whole"))
        times, rows = group.column("ts"), []
        for s in np.flatnonzero(own & swept).tolist():
            last = min(s + USABLE, len(own) - 1)
            falls = (x["close"][s + 1 : last] < x["structure"][s]) & (x["close"][s + 1 : last] < x["open"][s + 1 : last])
            for j in (np.flatnonzero(falls) + s + 1).tolist():
                origin, base = x["high"][s : j + 1].max(), x["low"][s : j + 1].min()
                if origin <= base:
                    continue
                bottom, top = (base + part * (origin - base) for part in ZONE)
                for t in range(j + 1, last + 1):
                    if x["high"][t] >= origin or x["low"][j + 1 : t].min(initial=np.inf) < base:
                        break
                    if whole[t] and bottom <= x["high"][t] <= top and x["close"][t] < min(bottom, x["open"][t], x["rh"][s]) and x["close"][t] > x["rl"][s]:
                        rows.append((t, s, j, origin, base, bottom, top))
                break  # the first break decides
        pick = lambda k: times.take(pa.array([r[k] for r in rows], pa.int64()))
        out = {"symbol": group.column("symbol").take(pa.array([r[1] for r in rows], pa.int64())), "ts": pick(0), "swept_at": pick(1), "broke_at": pick(2)}
        swept_rows = np.array([r[1] for r in rows], int)
        out |= {"reference_high": x["rh"][swept_rows], "reference_low": x["rl"][swept_rows], "structure": x["structure"][swept_rows]}
        return pa.table(out | {c: pa.array([r[k] for r in rows], pa.float64()) for k, c in ((3, "origin"), (4, "base"), (5, "zone_low"), (6, "zone_high"))})

    names = "reference_high reference_low structure origin base zone_low zone_high".split()
    schema = f"symbol string, ts {kind}, swept_at {kind}, broke_at {kind}, " + ", ".join(f"{c} double" for c in names)
    dealt = haloed(b.select("symbol", "ts", "i", "sweep", "__whole", *numbers), "i", BLOCK, after=USABLE + 1)
    found = dealt.groupBy("symbol", "__block").applyInArrow(run, schema)
    latest = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy(F.desc("swept_at")))
    return found.withColumn("__n", latest).where("__n = 1").drop("__n")
