"""Multiple-testing adjustment and moving-block bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adjust(p_values: DataFrame, *family: str) -> DataFrame:
    """p_holm and p_bh of p within each family (a bounded declared set of comparisons), with its size; undefined p count in it."""
    whole = Window.partitionBy(*family)
    up, down = whole.orderBy(F.col("p").asc_nulls_last(), "name").rowsBetween(Window.unboundedPreceding, 0), whole.orderBy(F.col("p").desc_nulls_last(), F.desc("name")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = p_values.withColumns({"__k": F.row_number().over(whole.orderBy(F.col("p").asc_nulls_last(), "name")), "family_size": F.count("*").over(whole)})
    holm = F.least(F.lit(1.0), F.max((F.col("family_size") - F.col("__k") + 1) * F.col("p")).over(up))
    bh = F.least(F.lit(1.0), F.min(F.col("p") * F.col("family_size") / F.col("__k")).over(down))
    return ranked.withColumns({"p_holm": F.when(F.col("p").isNotNull(), holm), "p_bh": F.when(F.col("p").isNotNull(), bh)}).drop("__k")


def block_positions(rows: int, resamples: int, block: int, seed: int, chosen: slice = slice(None)):
    """(resamples, rows) source positions of a moving-block bootstrap that does not wrap; equal seeds give equal positions.
    Each resample has a seed of its own, so that the chosen ones are drawn without the others."""
    import numpy as np

    blocks = -(-rows // block)
    starts = np.array([np.random.default_rng((seed, r)).integers(0, max(1, rows - block + 1), size=blocks) for r in range(resamples)[chosen]], np.int64).reshape(-1, blocks)
    return (starts[:, :, None] + np.arange(min(block, rows))).reshape(len(starts), -1)[:, :rows]


#: Resamples of one task, and positions that it lays out at once.
SHARE, LAID_OUT = 250, 1 << 20
METRICS = ("mean_return", "annualized_volatility", "sharpe", "cumulative_log", "max_drawdown")


def resampled_metrics(r, year: int):
    """METRICS of returns (..., sessions) along the last axis; a ratio without deviation is undefined (NaN)."""
    import numpy as np

    mean, sd = r.mean(-1), r.std(-1, ddof=1) if r.shape[-1] > 1 else np.full(r.shape[:-1], np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        grown = np.cumsum(np.log1p(r), axis=-1)
        fall = np.exp(grown - np.maximum(np.maximum.accumulate(grown, axis=-1), 0.0)).min(-1) - 1
        return {"mean_return": mean, "annualized_volatility": sd * year**0.5, "sharpe": np.where(sd > 0, mean / sd * year**0.5, np.nan), "cumulative_log": grown[..., -1], "max_drawdown": fall}


def paired_bootstrap(returns: DataFrame, *keys: str, subject: str, pairs: tuple[tuple[str, str], ...] | None = None, resamples: int = 2000, block: int = 21, seed: int = 7, confidence: float = 0.95, year: int = 252, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Intervals of metrics for each key's subjects, and of the differences of pairs of them: keys, first, second (null for a subject alone), metric, estimate, low, median,
    high, finite, p_value (two-sided, from the centred resamples, for a value or difference of 0).

    All subjects of a key are resampled at the same positions, which depend on seed and length only. pairs: those compared, or all of them by name. Sessions that lack a
    subject's return are left out for all of that key. A key's rows are dealt once for each share of the resamples; of each share come arrays of its samples.
    """
    import pyarrow as pa

    shares = -(-resamples // SHARE)
    names = [k for k in keys]

    def run(group: pa.Table) -> pa.Table:
        import numpy as np

        share = group.column("share")[0].as_py()
        who, name_of = np.unique(np.array(group.column("__subject").to_pylist(), object).astype(str), return_inverse=True)
        when, at = np.unique(group.column("ts").to_numpy(), return_inverse=True)
        r = np.full((len(who), len(when)), np.nan)
        r[name_of, at] = group.column("daily_return").to_numpy(zero_copy_only=False)
        r = r[:, ~np.isnan(r).any(axis=0)]
        n, rows = r.shape[1], []
        if n:
            chosen = range(resamples)[share::shares]
            parts, step = [], max(1, LAID_OUT // (n * len(who)))
            for k in range(0, len(chosen), step):
                part = chosen[k : k + step]
                parts.append(resampled_metrics(r[:, block_positions(n, resamples, block, seed, slice(part.start, part.stop, part.step))], year))
            drawn, whole = {m: np.concatenate([p[m] for p in parts], axis=1) for m in metrics}, resampled_metrics(r, year)
            index = {w: i for i, w in enumerate(who.tolist())}
            asked = [(a, b) for i, a in enumerate(index) for b in [*index][i + 1 :]] if pairs is None else [p for p in pairs if p[0] in index and p[1] in index]
            for m in metrics:
                rows += [(w, None, m, float(whole[m][i]), drawn[m][i]) for w, i in index.items()]
                rows += [(a, b, m, float(whole[m][index[a]] - whole[m][index[b]]), drawn[m][index[a]] - drawn[m][index[b]]) for a, b in asked]
        heads = {k: pa.array([group.column(k)[0].as_py()] * len(rows), group.schema.field(k).type) for k in names}
        finite = lambda x: x[np.isfinite(x)].tolist()
        texts = {c: pa.array([x[i] for x in rows], pa.string()) for i, c in enumerate(("first", "second", "metric"))}
        return pa.table({**heads, **texts, "estimate": pa.array([x[3] if np.isfinite(x[3]) else None for x in rows], pa.float64()), "samples": pa.array([finite(x[4]) for x in rows], pa.list_(pa.float64()))})

    schema = "".join(f"`{k}` {returns.schema[k].dataType.simpleString()}, " for k in keys) + "first string, second string, metric string, estimate double, samples array<double>"
    dealt = returns.select(*keys, "ts", "daily_return", F.col(subject).cast("string").alias("__subject"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    found = dealt.groupBy(*keys, "share").applyInArrow(run, schema)
    out = found.groupBy(*keys, "first", "second", "metric").agg(F.first("estimate").alias("estimate"), F.sort_array(F.flatten(F.collect_list("samples"))).alias("s"))
    extreme = F.size(F.filter("s", lambda v: F.abs(v - F.col("estimate")) >= F.abs("estimate")))
    tail = (1 - confidence) / 2
    finite = F.size("s")
    return out.select(
        *keys, "first", "second", "metric", "estimate", quantile(F.col("s"), tail).alias("low"), quantile(F.col("s"), 0.5).alias("median"), quantile(F.col("s"), 1 - tail).alias("high"), finite.cast("long").alias("finite"),
        F.when(F.col("estimate").isNotNull() & (finite > 0), (1 + extreme) / (finite + 1)).alias("p_value"),
    )


def quantile(ordered, share: float):
    """The value at a share of a sorted array, between two values in proportion; null for an empty one."""
    at = (F.size(ordered) - 1) * F.lit(share)
    below = F.floor(at).cast("int")
    low, high = F.get(ordered, below), F.get(ordered, F.least(below + 1, F.size(ordered) - 1))
    return low + (high - low) * (at - below)


def bootstrap(returns: DataFrame, *keys: str, resamples: int, block: int, seed: int, year: int = 252) -> DataFrame:
    """Interval and median of metrics over resamples of each key's series: keys, metric, low, median, high, finite,
    and p_value, two-sided from the centred resamples, for a metric of 0."""
    one = paired_bootstrap(returns.withColumn("__one", F.lit("series")), *keys, subject="__one", pairs=(), resamples=resamples, block=block, seed=seed, year=year, metrics=METRICS[:4])
    return one.select(*keys, "metric", "low", "median", "high", "finite", "p_value")


def one_sided(returns: DataFrame, *keys: str, value: str = "r", resamples: int = 4000, seed: int = 7) -> DataFrame:
    """keys, n and p for a mean of at most 0 against one above it, over blocks of n^(1/3) values by ts; null below 10 values."""
    shares = -(-resamples // SHARE)

    def run(group):
        import numpy as np
        import pandas as pd

        share = int(group["share"].iloc[0])
        r = group.sort_values("ts")[value].to_numpy(float)
        estimate, extreme = r.mean(), 0
        if len(r) >= 10 and estimate > 0:
            means = r[block_positions(len(r), resamples, max(1, round(len(r) ** (1 / 3))), seed, slice(share, None, shares))].mean(1)
            extreme = int(np.count_nonzero(means - estimate >= estimate))
        out = pd.DataFrame({"n": [len(r)], "estimate": [estimate], "extreme": [extreme]})
        for k in reversed(keys):
            out.insert(0, k, group[k].iloc[0])
        return out

    schema = ", ".join(f"`{k}` {returns.schema[k].dataType.simpleString()}" for k in keys) + ", n long, estimate double, extreme long"
    dealt = returns.select(*keys, "ts", value, F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    out = dealt.groupBy(*keys, "share").applyInPandas(run, schema).groupBy(*keys).agg(F.first("n").alias("n"), F.first("estimate").alias("e"), F.sum("extreme").alias("extreme"))
    p = F.when(F.col("n") < 10, F.lit(None).cast("double")).when(F.col("e") <= 0, 1.0).otherwise((1 + F.col("extreme")) / (resamples + 1))
    return out.select(*keys, "n", p.alias("p"))
