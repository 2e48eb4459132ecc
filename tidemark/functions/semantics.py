"""Shared semantics: windows by instrument, full-window guards, ratios, runs, ordered scans and as-of values.

Undefined stays null: a ratio without a denominator, a window without its full history, a state before its first input. Every
window is partitioned by instrument; none sees rows after its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Decimals to which ratios are rounded, so that binary noise does not decide thresholds.
RATIO_DECIMALS = 10


def by(*keys: str, ts: str = "ts") -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy(ts)


def trailing(n: int, *keys: str, ts: str = "ts") -> WindowSpec:
    """The last n rows, the current one included."""
    return by(*keys, ts=ts).rowsBetween(-(n - 1), 0)


def prior(n: int, *keys: str, ts: str = "ts") -> WindowSpec:
    """The n rows strictly before the current one."""
    return by(*keys, ts=ts).rowsBetween(-n, -1)


def following(n: int, *keys: str, ts: str = "ts") -> WindowSpec:
    return by(*keys, ts=ts).rowsBetween(1, n)


def running(*keys: str, ts: str = "ts") -> WindowSpec:
    return by(*keys, ts=ts).rowsBetween(Window.unboundedPreceding, 0)


def full(value: Column, x: Column, window: WindowSpec, n: int) -> Column:
    """An aggregate over the window where all n of its x are defined."""
    return F.when(F.count(x).over(window) == n, value.over(window))


def rolling_mean(x: str | Column, n: int, *keys: str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return full(F.avg(x), x, trailing(n, *keys), n)


def prior_mean(x: str | Column, n: int, *keys: str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return full(F.avg(x), x, prior(n, *keys), n)


def ratio(num: Column, den: Column) -> Column:
    """num / den rounded; null where den is 0."""
    return F.round(F.try_divide(num, den), RATIO_DECIMALS)


def correlation(x: str | Column, y: str | Column) -> Column:
    """Correlation of the pairs without a null: NaN, as in the SQL, where one side does not vary (corr() then fails by a division by
    zero), null without a pair."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    met = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(met, x)) * F.stddev_pop(F.when(met, y))
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop(x, y), spread))


def positive_ratio(num: Column, den: Column) -> Column:
    """num / den rounded; null unless den is above 0."""
    return F.when(den > 0, F.round(num / den, RATIO_DECIMALS))


def lagged(x: str | Column, k: int = 1, *keys: str) -> Column:
    return F.lag(x, k).over(by(*keys))


def run_starts(x: Column, *keys: str, ts: str = "ts") -> Column:
    """Whether a row's value differs from the one before; the first row of an instrument begins a run."""
    return ~x.eqNullSafe(F.lag(x).over(by(*keys, ts=ts))) | (F.row_number().over(by(*keys, ts=ts)) == 1)


def with_runs(df: DataFrame, x: str, *keys: str, run: str = "run_id", age: str = "run_age", ts: str = "ts") -> DataFrame:
    """Number of each run of equal values, and how many rows it has lasted with the current one."""
    keys = keys or ("symbol",)
    place = F.row_number().over(by(*keys, ts=ts))
    marked = df.withColumns({"__starts": run_starts(F.col(x), *keys, ts=ts), "__place": place})
    since = F.last(F.when(F.col("__starts"), F.col("__place")), ignorenulls=True).over(running(*keys, ts=ts))
    return marked.withColumns({run: F.sum(F.col("__starts").cast("long")).over(running(*keys, ts=ts)), age: (F.col("__place") - since + 1).cast("long")}).drop("__starts", "__place")


def last_known(x: Column, *keys: str, ts: str = "ts") -> Column:
    """The latest defined value up to the current row."""
    return F.last(x, ignorenulls=True).over(running(*keys, ts=ts))


def asof(left: DataFrame, right: DataFrame, value: str, *keys: str, ts: str = "ts", into: str | None = None, strict: bool = False) -> DataFrame:
    """left with the latest value of right dated at or before (strict: before) each row, by one pass over the sorted union.

    The rows of right come first at equal times unless strict. keys may be empty only for small dimension-like inputs, as
    all rows then share one window.
    """
    into = into or value
    tagged = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(0 if strict else 1).alias("__side"))
    other = right.select(*[F.col(c) if c in (*keys, ts) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(value).alias("__v"), F.lit(1 if strict else 0).alias("__side"))
    w = Window.partitionBy(*keys).orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = tagged.unionByName(other).withColumn(into, F.last("__v", ignorenulls=True).over(w))
    return both.where(F.col("__side") == (0 if strict else 1)).select(*left.columns, into)


def smoothed(df: DataFrame, inputs: dict[str, tuple[str, int, float]], *keys: str, ts: str = "ts") -> DataFrame:
    """Recursive smoothers: column -> (input, n, alpha). The first output is the mean of the first n defined inputs at the n-th,
    then y = alpha x + (1 - alpha) y. An input undefined after its first value leaves that row and the later ones undefined. A key's rows are
    split into blocks of time that many tasks smooth (scans.smoothers)."""
    from tidemark.functions.scans import smoothers

    return smoothers(df, inputs, *keys, ts=ts)


#: Rows that one task ranks at a time, beside those that they look back on.
RANK_BLOCK = 8192


def with_ranks(df: DataFrame, x: str, lookback: int, *keys: str, ts: str = "ts", block: int = RANK_BLOCK) -> DataFrame:
    """df with __below, __equal and __count: of the lookback rows before each row, those with a smaller x, with the same x, and
    with any. __below and __equal are null where x is.

    A row's rank needs the values of its frame, which a running aggregate does not hold. Rows are numbered and cut into blocks;
    each block gets the last rows before it again, so that a long history is ranked by many tasks of bounded size.
    """
    import numpy as np
    from pyspark.sql import types as T

    keys = keys or ("symbol",)
    block = max(block, lookback)
    placed = df.withColumn("__i", (F.row_number().over(by(*keys, ts=ts)) - 1).cast("long"))
    home = F.floor(F.col("__i") / block).cast("long")
    lead = (F.col("__i") % block >= block - lookback)
    shared = placed.withColumn("__block", F.explode(F.when(lead, F.array(home, home + 1)).otherwise(F.array(home))))
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType()) for c in ("__below", "__equal", "__count")]])
    names = df.columns

    def run(group):
        import pyarrow as pa

        group = group.sort_by("__i")
        v = group.column(x).cast(pa.float64()).to_numpy().astype(float)
        place, own = group.column("__i").to_numpy(), group.column("__block")[0].as_py() * block
        begin = int(np.searchsorted(place, own))
        padded = np.concatenate([np.full(lookback, np.nan), v])
        frames = np.lib.stride_tricks.sliding_window_view(padded, lookback)
        found = np.zeros((3, len(v) - begin), np.int64)
        for a in range(begin, len(v), 1024):
            z = min(a + 1024, len(v))
            f, now = frames[a:z], v[a:z, None]
            found[:, a - begin : z - begin] = (f < now).sum(1), (f == now).sum(1), (~np.isnan(f)).sum(1)
        mine, undefined = group.select(names).slice(begin), np.isnan(v[begin:])
        for name, values, mask in zip(("__below", "__equal", "__count"), found, (undefined, undefined, None)):
            mine = mine.append_column(name, pa.array(values, pa.int64(), mask=mask))
        return mine

    return shared.groupBy(*keys, "__block").applyInArrow(run, schema)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Doubles without NaN: missing values are null everywhere in the library."""
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast(t)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


#: Added before a result is rounded, so that exact halves do not hang on the last bit of a double.
NUDGE = 1e-9


def settled(x: Column, decimals: int = 6) -> Column:
    """A result rounded such that engines with different summation orders agree."""
    return F.round(x + NUDGE, decimals)


def rounded(df: DataFrame, decimals: int = 6) -> DataFrame:
    """All doubles settled, for comparison across engines."""
    return df.select(*[settled(F.col(c), decimals).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
