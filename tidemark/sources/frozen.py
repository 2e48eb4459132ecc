"""Frozen CSV files with declared columns, and rules whose violations come out as rows.

A file's columns are found by their names, in any order and among others. Lines that do not have the header's number of fields and values that are not of the declared type are violations; strict
reading refuses a file that has any, naming the first ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = {c: "double" for c in ("open", "high", "low", "close", "adj_close", "volume", "dividends", "splits")}
RATE = {"OBS_VALUE": "double"}
#: Violations that an error names.
NAMED = 5


class FrozenFileError(ValueError):
    """A frozen file that is not as declared."""


def raw_lines(spark: SparkSession, path: str, date: str, columns: dict[str, str]) -> DataFrame:
    """file, line (the text of a line with too few or too many fields, else null), date and columns as text. Files must have the declared columns; each file may order them as the first one does."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in (date, *columns) if c not in header]
    if missing:
        raise FrozenFileError(f"{path} lacks the columns {missing}")
    schema = ", ".join(f"`{c}` string" for c in header) + ", `__line` string"
    # all columns are parsed whatever is asked for, else a line with missing fields goes unseen
    read = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__line").option("columnPruning", False).csv(path)
    return read.select(F.input_file_name().alias("file"), F.col("__line").alias("line"), F.col(date).alias(date), *[F.col(c) for c in columns])


def typed(raw: DataFrame, date: str, columns: dict[str, str]) -> DataFrame:
    """The values as declared, null where a text is none, with problems: of each row the names of its bad columns, or of its line."""
    at = F.try_to_timestamp(F.col(date), F.lit("yyyy-MM-dd")).cast("date")
    bad = [F.when(F.col(c).isNotNull() & F.expr(f"try_cast(trim(`{c}`) as {t})").isNull(), F.lit(c)) for c, t in columns.items()]
    named = F.array(F.when(F.col("line").isNotNull(), "line"), F.when(at.isNull() | (F.length(F.trim(date)) != 10), F.lit(date)), *bad)
    return raw.select("file", "line", at.alias("date"), *[F.expr(f"try_cast(trim(`{c}`) as {t})").alias(c) for c, t in columns.items()], F.filter(named, lambda c: c.isNotNull()).alias("problems"))


def violations(rows: DataFrame) -> DataFrame:
    """file, problem, date, line of what is not as declared."""
    return rows.select("file", F.explode("problems").alias("problem"), "date", "line")


def read_frozen(spark: SparkSession, path: str, date: str, columns: dict[str, str], end: str | None = None) -> DataFrame:
    """date and columns up to end (included). A file with violations, or with a date twice, is refused."""
    rows = typed(raw_lines(spark, path, date, columns), date, columns)
    found = violations(rows).limit(NAMED).collect()
    if found:
        raise FrozenFileError("; ".join(f"{r['problem']} at {r['date'] or r['line'] or 'an unreadable date'}" for r in found))
    twice = rows.groupBy("date").count().where("count > 1").limit(1).collect()
    if twice:
        raise FrozenFileError(f"{twice[0]['date']} occurs {twice[0]['count']} times")
    out = rows.select("date", *columns)
    return out if end is None else out.where(F.col("date") <= F.lit(end).cast("date"))


def price_csv(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    return read_frozen(spark, path, "date", PRICES, end)


def rate_csv(spark: SparkSession, path: str, end: str | None = None) -> DataFrame:
    """date and value of a file of observations (TIME_PERIOD, OBS_VALUE among others)."""
    return read_frozen(spark, path, "TIME_PERIOD", RATE, end).withColumnRenamed("OBS_VALUE", "value")


# Rules


def broken(rows: DataFrame, rules: dict[str, Column], *subject: str) -> DataFrame:
    """rule and subject for each row and rule that does not hold; an unknown condition does not hold."""
    found = F.filter(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]), lambda r: r.isNotNull())
    return rows.withColumn("__r", found).select(F.explode("__r").alias("rule"), F.concat_ws(" ", *subject).alias("subject"))


def chronology(rows: DataFrame, part: str, train: str, ts: str, *keys: str) -> DataFrame:
    """keys, last (of the training rows), first (of all others) and ordered: whether every training row comes before all others. Without either there is nothing to order."""
    is_train = F.col(part) == train
    out = rows.groupBy(*keys).agg(F.max(F.when(is_train, F.col(ts))).alias("last"), F.min(F.when(~is_train, F.col(ts))).alias("first"))
    return out.withColumn("ordered", F.coalesce(F.col("last") < F.col("first"), F.lit(True)))


def universe_violations(assets: DataFrame, legs: DataFrame, classes: DataFrame, least: int = 4, most: int = 8) -> DataFrame:
    """rule and subject of what is wrong in a universe of assets (id, symbol, kind, tracks, product_tracks, cost_class) and benchmark legs (id, same_as, symbol, weight): too few or too many assets, an id or a
    symbol twice, an unknown cost class, a proxy that tracks another index than its product, weights that do not add up to 1, a leg that refers to no asset or takes an asset's id. Ids and classes null are wrong too."""
    one = lambda df, rule, holds, subject: broken(df, {rule: holds}, subject)
    number = assets.agg(F.count("*").alias("n"))
    own = legs.where("same_as is null").select("id", "symbol")
    series = assets.select("id", "symbol").unionByName(own)
    found = [
        broken(number, {"asset_count": F.col("n").between(least, most)}, "n"),
        one(assets.groupBy("id").count(), "duplicate_id", F.col("id").isNotNull() & (F.col("count") == 1), "id"),
        one(series.groupBy("symbol").count(), "duplicate_symbol", F.col("symbol").isNotNull() & (F.col("count") == 1), "symbol"),
        broken(assets.join(classes.select(F.col("cost_class"), F.lit(True).alias("__known")).distinct(), "cost_class", "left"), {"unknown_cost_class": F.col("__known")}, "id", "cost_class"),
        one(assets, "series_differs", (F.col("kind") != "proxy") | F.col("tracks").eqNullSafe(F.col("product_tracks")), "id"),
        broken(legs.agg(F.round(F.sum("weight"), 9).alias("total")), {"leg_weights": F.abs(F.col("total") - 1) <= 1e-12}, "total"),
        one(legs.where("same_as is not null").join(assets.select(F.col("id").alias("same_as"), F.lit(True).alias("__known")).distinct(), "same_as", "left"), "unknown_asset", F.col("__known"), "same_as"),
        one(own.join(assets.select("id", F.lit(False).alias("__free")).distinct(), "id", "left"), "leg_id_clashes", F.coalesce("__free", F.lit(True)), "id"),
    ]
    return reduce(DataFrame.unionByName, found)
