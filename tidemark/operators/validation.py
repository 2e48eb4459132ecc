"""Validation of strategies: scenarios of costs over slices of time in one pass, gates, and how a model's ranking and a signal's timing compare with chance."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scans import taken
from tidemark.functions.semantics import by
from tidemark.operators.statistics import LAID_OUT, SHARE, block_positions, quantile

# Scenarios


def scenario_cube(targets: DataFrame, bars: DataFrame, scenarios: DataFrame, slice_of: Column, year: int = 252) -> DataFrame:
    """Metrics of each (symbol, strategy, scenario, slice) and, as slice "full", of all slices together: sessions, log_growth, mean, sharpe, max_drawdown, orders, log_costs.

    targets (symbol, ts, strategy, target of 0 or 1), executed at the next open. scenarios (scenario, bps): a short list; an order costs bps of its notional, so that equity is a
    product of factors (a purchase of all cash leaves 1 / (1 + c), a sale 1 - c) and needs no fold. slice_of names a bar's slice from its columns. The scenario is an exploded key, slices and
    the whole come from one grouping; drawdowns run within a slice and along the whole, in windows of one exchange.
    """
    keys = ["symbol", "strategy", "scenario"]
    df = targets.select("symbol", "ts", "strategy", "target").join(bars.select("symbol", "ts", "open", "close"), ["symbol", "ts"])
    own = by("symbol", "strategy")
    df = df.withColumns({"position": F.coalesce(F.lag("target").over(own), F.lit(0.0)), "__last": F.lag("close").over(own)})
    df = df.withColumn("held", F.coalesce(F.lag("position").over(own), F.lit(0.0)))
    now, then = F.col("position") > 0, F.col("held") > 0
    free = F.when(now & then, F.ln(F.col("close") / F.col("__last"))).when(now, F.ln(F.col("close") / F.col("open"))).when(then, F.ln(F.col("open") / F.col("__last"))).otherwise(0.0)
    listed = scenarios.agg(F.collect_list(F.struct("scenario", (F.col("bps") / 1e4).alias("c"))).alias("__scenarios"))
    df = df.withColumns({"__free": free, "slice": slice_of}).join(F.broadcast(listed)).withColumn("__s", F.explode("__scenarios")).drop("__scenarios")
    cost = F.when(now & ~then, -F.log1p(F.col("__s.c"))).when(then & ~now, F.log1p(-F.col("__s.c"))).otherwise(0.0)
    df = df.select("symbol", "strategy", F.col("__s.scenario").alias("scenario"), "slice", "ts", (F.col("__free") + cost).alias("growth"), cost.alias("cost"), (now != then).cast("int").alias("order"))

    def fall(*part: str) -> Column:
        along = Window.partitionBy(*part).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        return along, F.sum("growth").over(along)

    whole, grown = fall(*keys)
    within, grown_in = fall(*keys, "slice")
    df = df.withColumns({"__g": grown, "__h": grown_in})
    df = df.withColumns({"__fall": F.exp(F.col("__g") - F.greatest(F.max("__g").over(whole), F.lit(0.0))) - 1, "__fall_in": F.exp(F.col("__h") - F.greatest(F.max("__h").over(within), F.lit(0.0))) - 1, "__r": F.exp("growth") - 1})
    out = df.groupingSets([[F.col(k) for k in (*keys, "slice")], [F.col(k) for k in keys]], *[F.col(k) for k in (*keys, "slice")]).agg(
        F.grouping("slice").alias("__all"), F.count("*").alias("sessions"), F.sum("growth").alias("log_growth"), F.avg("__r").alias("mean"), F.stddev_samp("__r").alias("__sd"),
        F.min("__fall").alias("__fall"), F.min("__fall_in").alias("__fall_in"), F.sum("order").alias("orders"), F.sum("cost").alias("log_costs"),
    )
    full = F.col("__all") == 1
    return out.select(
        *keys, F.when(full, "full").otherwise(F.col("slice")).alias("slice"), "sessions", "log_growth", "mean", (F.try_divide("mean", "__sd") * year**0.5).alias("sharpe"),
        F.when(full, F.col("__fall")).otherwise(F.col("__fall_in")).alias("max_drawdown"), "orders", "log_costs",
    )


def gates(m: DataFrame) -> DataFrame:
    """m with six gates and passed (all of them), of one row a strategy: cagr, cash_cagr, sharpe, max_drawdown (positive), double_return, parts (returns of four subperiods), profits (by
    asset), and benchmark_sharpe, benchmark_drawdown. An undefined measure fails its gate."""
    at_least = F.size(F.filter("parts", lambda r: r >= 0))
    gains = F.filter("profits", lambda v: v > 0)
    positive = F.aggregate(gains, F.lit(0.0), lambda a, v: a + v)
    share = F.try_divide(F.coalesce(F.array_max(gains), F.lit(0.0)), positive)
    rules = {
        "gate_cash": F.col("cagr") > F.col("cash_cagr"), "gate_sharpe": (F.col("sharpe") >= 0.40) & (F.col("sharpe") > F.col("benchmark_sharpe")),
        "gate_drawdown": (F.col("max_drawdown") <= 0.20) & (F.col("max_drawdown") < F.col("benchmark_drawdown")), "gate_costs": F.col("double_return") > 0,
        "gate_parts": at_least >= 3, "gate_spread": (positive > 0) & (share <= 0.40),
    }
    out = m.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in rules.items()})
    passed = F.lit(True)
    for k in rules:
        passed = passed & F.col(k)
    return out.withColumn("passed", passed)


def verdict(passed: Column, lower: Column, failed: Column) -> Column:
    """EDGE only where all gates pass and the lower bound of the Sharpe ratio is above 0; what can't be judged is INSUFFICIENT."""
    return F.when(failed, "INSUFFICIENT").when(~passed, "NO EDGE").when(lower > 0, "EDGE").otherwise("INSUFFICIENT")


def formal_status(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """tests (p_holm) with the status of each declared test; an undefined p is no evidence."""
    known = F.col("p_holm").isNotNull() & ~F.isnan("p_holm")
    return tests.withColumn("status", F.when(~known, "undefined (insufficient evidence)").when(F.col("p_holm") < alpha, f"significant at {alpha:g} (Holm)").otherwise(f"not significant at {alpha:g}"))


def conclusion(tests: DataFrame, benchmark: str, timing: tuple[str, ...], *keys: str, alpha: float = 0.05) -> DataFrame:
    """keys, edge, and the strategies (first, metric) that are better than the benchmark (second) by a positive and significant difference, in order."""
    better = F.coalesce((F.col("second") == benchmark) & F.col("first").isin(*timing) & (F.col("estimate") > 0) & (F.col("p_holm") < alpha), F.lit(False))
    named = F.array_sort(F.collect_list(F.when(better, F.concat("first", F.lit(" ("), "metric", F.lit(")")))))
    return tests.groupBy(*keys).agg(F.max(better).alias("edge"), F.concat_ws(", ", named).alias("better"))


# Ranking


def weighted_auc(order_of, positive, negative):
    """Area under the curve of counts (resamples, rows) of both classes, of scores in groups of equals (order_of: each row's, by rising score): the chance that a positive
    stands above a negative, ties half. NaN where a class is missing."""
    import numpy as np

    groups = int(order_of.max()) + 1 if len(order_of) else 0
    first = np.searchsorted(order_of, np.arange(groups))
    p, n = (np.add.reduceat(x, first, axis=1) for x in (positive, negative))
    below = np.cumsum(n, axis=1) - n
    pairs = p.sum(axis=1) * n.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(pairs > 0, (p * (below + 0.5 * n)).sum(axis=1) / pairs, np.nan)


def auc_interval(scores: DataFrame, *keys: str, resamples: int = 2000, block: int = 21, seed: int = 7, confidence: float = 0.95) -> DataFrame:
    """keys, n, auc, low, high and valid (resamples with both classes) of scores (keys, ts, y: 0 or 1, p). Rows are ordered by ts for the blocks. Scores are sorted once into groups of equals; a
    resample is how often it takes each row, and its area a cumulative sum over the groups. Shares of the resamples are dealt over tasks."""
    shares = -(-resamples // SHARE)

    def run(group: pa.Table) -> pa.Table:
        import numpy as np

        group = group.sort_by([("ts", "ascending"), ("p", "ascending"), ("y", "ascending")])
        share, n = group.column("share")[0].as_py(), len(group)
        y, p = group.column("y").to_numpy().astype(float), group.column("p").to_numpy().astype(float)
        order = np.argsort(p, kind="stable")
        equals = np.unique(p[order], return_inverse=True)[1]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        y = y[order]
        samples, chosen = [], range(resamples)[share::shares]
        step = max(1, LAID_OUT // n)
        for k in range(0, len(chosen), step):
            part = chosen[k : k + step]
            at = place[block_positions(n, resamples, block, seed, slice(part.start, part.stop, part.step))]
            times = np.zeros((len(at), n))
            np.add.at(times, (np.arange(len(at))[:, None], at), 1.0)
            samples.append(weighted_auc(equals, times * y, times * (1 - y)))
        point = weighted_auc(equals, y[None], 1 - y[None])[0]
        found = np.concatenate(samples)
        heads = {k: pa.array([group.column(k)[0].as_py()], group.schema.field(k).type) for k in keys}
        return pa.table({**heads, "n": pa.array([n], pa.int64()), "auc": pa.array([None if np.isnan(point) else float(point)], pa.float64()), "s": pa.array([found[~np.isnan(found)].tolist()], pa.list_(pa.float64()))})

    known = scores.where("y is not null and p is not null and not isnan(p)").select(*keys, "ts", F.col("y").cast("double").alias("y"), F.col("p").cast("double").alias("p"))
    dealt = known.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    schema = "".join(f"`{k}` {scores.schema[k].dataType.simpleString()}, " for k in keys) + "n long, auc double, s array<double>"
    out = dealt.groupBy(*keys, "share").applyInArrow(run, schema).groupBy(*keys).agg(F.first("n").alias("n"), F.first("auc").alias("auc"), F.sort_array(F.flatten(F.collect_list("s"))).alias("s"))
    tail = (1 - confidence) / 2
    return out.select(*keys, "n", "auc", quantile(F.col("s"), tail).alias("low"), quantile(F.col("s"), 1 - tail).alias("high"), F.size("s").cast("long").alias("valid"))


# Timing


def random_timing(outcomes: DataFrame, signals: DataFrame, reps: int = 50, seed: str = "11", longest: int = 96) -> DataFrame:
    """Trades of the signals and of reps random strategies, each symbol's signals moved to as many random bars with random directions: rep (-1: the signals themselves), symbol, trades and
    sum_r.

    outcomes (symbol, i, dir, bars, net_r): what a position opened after bar i would bring; bars with both directions are allowed. signals (symbol, i, dir). Bars are drawn without replacement as those
    of the smallest keyed hashes, and a position runs alone (scans.taken), so that nothing depends on the order of rows.
    """
    allowed = outcomes.where("net_r is not null").groupBy("symbol", "i").agg(F.count_distinct("dir").alias("n")).where("n = 2").select("symbol", "i")
    real = signals.join(allowed, ["symbol", "i"])
    wanted = real.groupBy("symbol").agg(F.count("*").alias("__wanted"))
    text = lambda *what: F.md5(F.concat_ws("|", *what).cast("binary"))
    drawn = allowed.join(wanted, "symbol").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    keyed = drawn.withColumn("__h", text(F.lit(seed), "rep", "symbol", "i"))
    rank = F.row_number().over(Window.partitionBy("rep", "symbol").orderBy("__h", "i"))
    side = F.when(F.substring("__h", 32, 1).isin(*"01234567"), -1).otherwise(1)
    chosen = keyed.withColumn("__rank", rank).where(F.col("__rank") <= F.col("__wanted")).select("rep", "symbol", "i", side.alias("dir"))
    every = chosen.unionByName(real.select(F.lit(-1).alias("rep"), "symbol", "i", F.col("dir").cast("int").alias("dir")))
    opened = every.join(outcomes.select("symbol", "i", F.col("dir").cast("int").alias("dir"), "bars", "net_r"), ["symbol", "i", "dir"]).withColumn("__end", F.col("i") + F.col("bars"))
    alone = taken(opened, "i", "__end", longest, "rep", "symbol")
    return alone.groupBy("rep", "symbol").agg(F.count("*").alias("trades"), F.sum("net_r").alias("sum_r"))


def timing_p(trades: DataFrame) -> DataFrame:
    """One row: trades and mean of the signals, mean and largest mean of the random strategies, reps, and p: the share of means at least as high, the signals' own counted."""
    means = trades.groupBy("rep").agg((F.sum("sum_r") / F.sum("trades")).alias("mean"), F.sum("trades").alias("trades"))
    real = means.where("rep < 0").select(F.col("mean").alias("real_mean"), F.col("trades").alias("real_trades"))
    joined = means.where("rep >= 0").join(F.broadcast(real))
    return joined.agg(
        F.first("real_trades").alias("trades"), F.first("real_mean").alias("mean"), F.avg("mean").alias("random_mean"), F.max("mean").alias("random_max"), F.count("*").alias("reps"),
        ((1 + F.count_if(F.col("mean") >= F.col("real_mean"))) / (F.count("*") + 1)).alias("p"),
    )
