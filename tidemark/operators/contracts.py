"""Contracts of intraday bars, quotes, signals and snapshots as counts of violations, and portable features of finite windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.semantics import by, full, lagged, prior, running, trailing, with_ranks

PRICES = ("open", "high", "low", "close")
#: Least share of neighbouring bars one grid step apart (fixed value).
ADJACENT = 0.8


def _unsound(prefix: str = "") -> Column:
    """Whether a bar has a price that is missing, not finite or not positive."""
    bad = [F.col(prefix + p).isNull() | F.isnan(prefix + p) | (F.col(prefix + p) <= 0) | (F.col(prefix + p) == float("inf")) for p in PRICES]
    return bad[0] | bad[1] | bad[2] | bad[3]


def _inconsistent(prefix: str = "") -> Column:
    o, h, low, c = (F.col(prefix + p) for p in PRICES)
    return F.coalesce((h < F.greatest(o, low, c)) | (low > F.least(o, h, c)), F.lit(False))


def closed(bars: DataFrame, minutes: int, now: str) -> DataFrame:
    """Bars that had ended by a time."""
    return bars.where(F.col("ts") + F.make_dt_interval(mins=F.lit(minutes)) <= F.lit(now).cast("timestamp_ntz"))


def grid_check(bars: DataFrame, minutes: int, sides: tuple[str, ...] = ("",)) -> DataFrame:
    """One row a symbol: bars off the grid, share of bars one step after their predecessor, bad and inconsistent prices, crossed
    closes where sides are bid and ask, and the first broken rule. Of bars at one time one counts. A symbol's first bar is in the
    share's denominator."""
    b = bars.dropDuplicates(["symbol", "ts"]).withColumn("step", F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(lagged("ts").cast("timestamp")))
    off = (F.unix_micros(F.col("ts").cast("timestamp")) % (minutes * 60_000_000)) != 0
    any_of = lambda f: F.greatest(*[f(s).cast("int") for s in sides], F.lit(0)) == 1
    crossed = F.coalesce(F.col("bid_close") > F.col("ask_close"), F.lit(False)) if len(sides) == 2 else F.lit(False)
    g = b.groupBy("symbol").agg(
        F.count("*").alias("bars"), F.count_if(off).alias("off_grid"), (F.count_if(F.col("step") == minutes * 60) / F.count("*")).alias("adjacent"),
        F.count_if(any_of(_unsound)).alias("bad_price"), F.count_if(any_of(_inconsistent)).alias("inconsistent"), F.count_if(crossed).alias("crossed"),
    )
    reason = F.when(F.col("off_grid") > 0, "off_grid").when(F.col("adjacent") < ADJACENT, "not_adjacent").when(F.col("bad_price") > 0, "bad_price").when(F.col("inconsistent") > 0, "inconsistent").when(F.col("crossed") > 0, "crossed").otherwise("")
    return g.withColumn("reason", reason)


def signal_contract(signals: DataFrame) -> DataFrame:
    """Violations a symbol of (dir, stop_dist, target_dist, score, max_hold): only rows with a direction have distances to keep."""
    acts = F.coalesce(F.col("dir") != 0, F.lit(False))
    positive = lambda c: F.coalesce((F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < float("inf")), F.lit(False))
    broken = {
        "dir": ~F.coalesce(F.col("dir").isin(-1, 0, 1), F.lit(False)), "stop_dist": acts & ~positive("stop_dist"), "target_dist": acts & ~positive("target_dist"),
        "score": acts & ~F.coalesce(F.col("score").between(0, 1), F.lit(False)), "max_hold": acts & ~F.coalesce(F.col("max_hold") >= 1, F.lit(False)),
    }
    return signals.groupBy("symbol").agg(F.count("*").alias("rows"), *[F.count_if(c).alias(f"bad_{n}") for n, c in broken.items()])


def engine_contract(bars: DataFrame) -> DataFrame:
    """Violations a symbol that an engine refuses: repeated times, prices that are not sound, inconsistent bars. Counts of a time's bars add up to a symbol's,
    so that no task holds or sorts the bars of a symbol."""
    times = bars.groupBy("symbol", "ts").agg(F.count("*").alias("n"), F.count_if(_unsound()).alias("bad"), F.count_if(_inconsistent()).alias("odd"))
    again = F.when(F.col("ts").isNotNull(), F.col("n") - 1).otherwise(0)
    return times.groupBy("symbol").agg(F.sum("n").alias("rows"), F.sum(again).alias("repeated"), F.sum("bad").alias("bad_price"), F.sum("odd").alias("inconsistent"))


def snapshot_safety(snapshots: DataFrame, initial: Column) -> DataFrame:
    """One row for each broken rule of a snapshot (id, cash, position, exposure, equity, pnl)."""
    off = F.col("pnl") - (F.col("equity") - initial)
    rules = (("negative_cash", F.col("cash") < 0, F.col("cash")), ("negative_position", F.col("position") < 0, F.col("position")), ("exposure_above_limit", F.col("exposure") > 1 + 1e-12, F.col("exposure")), ("accounting", F.abs(off) > 1e-6 * F.greatest(F.lit(1.0), initial), off))
    each = F.explode(F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(n).alias("rule"), v.cast("double").alias("value"))) for n, bad, v in rules])))
    return snapshots.select("id", each.alias("f")).select("id", "f.rule", "f.value")


def portable(bars: DataFrame, minutes: int) -> DataFrame:
    """Moves, gaps and distances in ranges, RSI, efficiency, the range's rank among the last 200 (ties in the middle; from 100 on)
    and the hour of the bar's end as an angle; all from finite windows, so that a bounded number of bars gives them exactly."""
    clip = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(-20.0), F.least(F.lit(20.0), x)))
    before = lagged("close")
    b = bars.withColumns({"tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)), "change": F.col("close") - before})
    b = b.withColumns({"up": F.greatest("change", F.lit(0.0)) + 0 * F.col("change"), "down": F.greatest(-F.col("change"), F.lit(0.0)) + 0 * F.col("change"), "way": F.abs("change")})
    mean = lambda c, n: full(F.avg(c), F.col(c), trailing(n), n)
    b = b.withColumns({"atr": mean("tr", 14), "gain": mean("up", 14), "loss": mean("down", 14), "fast": mean("close", 20), "slow": mean("close", 60), "path": full(F.sum("way"), F.col("way"), trailing(20), 20), "net": F.abs(F.col("close") - lagged("close", 20))})
    b = b.withColumn("atr", F.round(F.when(F.col("atr") > 0, F.col("atr")), 10))
    b = with_ranks(b, "atr", 199)
    seen = F.col("__count") + 1
    rank = F.when(F.col("atr").isNotNull() & (seen >= 100), (F.col("__below") + F.col("__equal") / 2 + 1) / seen)
    end = F.unix_seconds(F.col("ts").cast("timestamp")) + minutes * 60
    angle = 2 * F.pi() * (end % 86_400) / 86_400
    moves = {f"move{k}": clip((F.col("close") - lagged("close", k)) / F.col("atr")) for k in (1, 4, 16)}
    total = F.col("gain") + F.col("loss")
    out = b.withColumns(moves | {
        "sma_gap": clip((F.col("fast") - F.col("slow")) / F.col("atr")), "distance": clip((F.col("close") - F.col("fast")) / F.col("atr")), "rsi_centered": F.when(total > 0, (100 * F.col("gain") / total - 50) / 50).when(total == 0, 0.0),
        "efficiency": F.when(F.col("path") > 0, F.col("net") / F.col("path")), "volatility_rank": rank, "hour_sin": F.sin(angle), "hour_cos": F.cos(angle),
    })
    return out.select("symbol", "ts", "atr", *moves, "sma_gap", "distance", "rsi_centered", "efficiency", "volatility_rank", "hour_sin", "hour_cos")


def analyst(f: DataFrame, tradable: Column, efficient: float = 0.35, quiet: float = 0.9) -> DataFrame:
    """Direction of the averages, whether the path is efficient, and whether the bar may be traded: all known, not too volatile."""
    finite = F.col("atr").isNotNull() & F.col("efficiency").isNotNull() & F.col("volatility_rank").isNotNull() & F.col("sma_gap").isNotNull()
    return f.select("symbol", "ts", F.signum(F.coalesce("sma_gap", F.lit(0.0))).cast("int").alias("trend"), F.coalesce(F.col("efficiency") >= efficient, F.lit(False)).cast("int").alias("regime"), (finite & tradable & (F.coalesce("volatility_rank", F.lit(1.0)) < quiet)).alias("tradable"))


def retracement(bars: DataFrame, n: int = 12, near: float = 0.62, far: float = 0.79) -> DataFrame:
    """Where the close stands in the range of the n bars before it, and the bounds of the deep retracement on either side."""
    low, high = full(F.min("low"), F.col("low"), prior(n), n), full(F.max("high"), F.col("high"), prior(n), n)
    b = bars.withColumns({"floor": low, "width": high - low})
    part = F.try_divide(F.col("close") - F.col("floor"), F.col("width"))
    top = F.col("floor") + F.col("width")
    return b.select("symbol", "ts", part.alias("fraction"), F.coalesce(part.between(near, far), F.lit(False)).alias("inside"), (top - far * F.col("width")).alias("bull_low"), (top - near * F.col("width")).alias("bull_high"), (F.col("floor") + near * F.col("width")).alias("bear_low"), (F.col("floor") + far * F.col("width")).alias("bear_high"))


def complete_buckets(bars: DataFrame, hours: int, expected: int) -> DataFrame:
    """Bars of so many hours from finer ones; a bucket that lacks any of them does not appear."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (hours * 3600)) * (hours * 3600)).cast("timestamp_ntz")
    g = bars.groupBy("symbol", start.alias("bucket")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.count("*").alias("n"))
    return g.where(F.col("n") == expected).select("symbol", F.col("bucket").alias("ts"), *PRICES)


def label_view(labels: DataFrame) -> DataFrame:
    """Each row's label, its age, whether it just changed, and the latest different label before it."""
    w = by()
    moved = labels.withColumn("before", F.lag("label").over(w)).withColumn("changed", F.coalesce(F.col("label") != F.col("before"), F.lit(False)))
    upto = running()
    m = moved.withColumns({"run": F.sum(F.col("changed").cast("long")).over(upto), "previous": F.last(F.when(F.col("changed"), F.col("before")), ignorenulls=True).over(upto)})
    return m.select("symbol", "ts", "label", F.row_number().over(by("symbol", "run")).cast("long").alias("age"), "changed", "previous")
