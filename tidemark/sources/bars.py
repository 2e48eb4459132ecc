"""Bar, quote and calendar sources, and their derivation from the order and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "adj_close")]])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_bars(spark: SparkSession, sf_dir: str, symbol: str = "l_returnflag") -> DataFrame:
    """Daily bars of order lines: symbol is the return flag (or another column, as text), a session a ship date, a price what a unit costs; first and last
    price go by the line's full key. adj_close halves closes before 1995, as a two-for-one split would."""
    lines = table(spark, sf_dir, "lineitem")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    bars = (
        lines.select(F.col(symbol).cast("string").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), key.alias("k"), price.alias("price"), "l_quantity")
        .groupBy("symbol", "ts")
        .agg(F.min_by("price", "k").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "k").alias("close"), F.sum("l_quantity").alias("volume"))
    )
    return bars.withColumn("adj_close", F.when(F.col("ts") < F.lit("1995-01-01").cast("timestamp_ntz"), F.col("close") / 2).otherwise(F.col("close")))


def event_bars(spark: SparkSession, sf_dir: str, hours: int = 4) -> DataFrame:
    """Bars of events: symbol is the event type, prices are values in buckets of so many hours, empty buckets are absent."""
    return resample(quotes(spark, sf_dir).select("symbol", "ts", "event_id", F.col("mid").alias("price")), hours * 3600)


def quotes(spark: SparkSession, sf_dir: str, spread: float = 0.0002) -> DataFrame:
    """Events as quotes: mid is the value, half the spread on either side."""
    events = table(spark, sf_dir, "events")
    mid = F.col("value")
    return events.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id"),
        mid.alias("mid"), (mid * (1 - spread / 2)).alias("bid"), (mid * (1 + spread / 2)).alias("ask"),
    )


def bucket_start(ts, seconds: int):
    """Start of the bucket of so many seconds since the epoch that holds a time."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds).cast("timestamp_ntz")


def resample(ticks: DataFrame, seconds: int) -> DataFrame:
    """OHLC and count of (symbol, ts, price) by left-closed buckets; buckets without rows do not appear. Of ticks at one time event_id, where there is one, else the price tells the first and the last."""
    order = F.struct("ts", "event_id" if "event_id" in ticks.columns else "price")
    return (
        ticks.withColumn("bucket", bucket_start(F.col("ts"), seconds))
        .groupBy("symbol", F.col("bucket").alias("ts"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume"))
    )


def sessions(bars: DataFrame) -> DataFrame:
    """The calendar that a set of bars spans: its distinct sessions with the next one's open."""
    days = bars.select("ts").distinct()
    from pyspark.sql import Window

    return days.withColumn("next_ts", F.lead("ts").over(Window.orderBy("ts")))


def closed_bars(bars: DataFrame, symbol: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of an instrument between two times, both included; predicates reach the scan."""
    for condition in ([F.col("symbol") == symbol] if symbol else []) + ([F.col("ts") >= F.lit(start).cast("timestamp_ntz")] if start else []) + ([F.col("ts") <= F.lit(end).cast("timestamp_ntz")] if end else []):
        bars = bars.where(condition)
    return bars


def five_minute_quotes(spark: SparkSession, sf_dir: str, spread: float = 0.0002) -> DataFrame:
    """Five-minute bars (symbol, ts, open, high, low, close) of a market that each event moves by a hundredth of its value less 50, from 1000 on.
    A bar opens at the price in force, so that a stretch without events holds flat bars; the market's days are those of all events."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("at"), "event_id", (F.round(F.col("value") * 100).cast("long") - 5000).alias("move"))
    order = Window.partitionBy("symbol").orderBy("at", "event_id")
    ticks = e.select("symbol", "at", "event_id", (1000 + F.sum("move").over(order.rowsBetween(Window.unboundedPreceding, 0)) / 10_000).alias("price"))
    seen = ticks.groupBy("symbol", bucket_start(F.col("at"), 300).alias("ts")).agg(F.max("price").alias("top"), F.min("price").alias("bottom"), F.max_by("price", F.struct("at", "event_id")).alias("close"))
    ends = seen.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = ends.select("symbol", F.explode(F.sequence("a", "b", F.expr("interval 5 minutes"))).alias("ts"))
    filled = grid.join(seen, ["symbol", "ts"], "left")
    w = Window.partitionBy("symbol").orderBy("ts")
    filled = filled.withColumn("close", F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    opened = F.coalesce(F.lag("close").over(w), F.lit(1000.0))
    return filled.withColumn("open", opened).select("symbol", "ts", "open", F.greatest("open", "close", "top").alias("high"), F.least("open", "close", "bottom").alias("low"), "close")


def five_minute_sides(spark: SparkSession, sf_dir: str, spread: float = 0.0002) -> DataFrame:
    """five_minute_quotes() as bars of both sides (symbol, side, ts, ...), half the spread from the middle."""
    mid = five_minute_quotes(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    sides = F.explode(F.array(F.struct(F.lit("BID").alias("side"), F.lit(1 - spread / 2).alias("f")), F.struct(F.lit("ASK").alias("side"), F.lit(1 + spread / 2).alias("f"))))
    return mid.withColumn("s", sides).select("symbol", "s.side", "ts", *[(F.col(c) * F.col("s.f")).alias(c) for c in ("open", "high", "low", "close")])
