"""Streams of quotes: tumbling bars, deduplicated alerts and keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.bars import table


def quote_stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Quotes (symbol, ts, bid, ask) from Parquet files of a folder as they appear."""
    return spark.readStream.schema("symbol string, ts timestamp, bid double, ask double").option("maxFilesPerTrigger", per_trigger).parquet(folder)


def stream_bars(quotes: DataFrame, width: str = "5 minutes", late: str = "0 seconds") -> DataFrame:
    """Mid OHLC (of quotes at one time the lowest opens and the highest closes), mean spread and count by symbol and tumbling window; in append mode a bar appears once the watermark has passed
    its end, so the last bar of a stream stays open."""
    mid = (F.col("bid") + F.col("ask")) / 2
    return (
        quotes.withColumns({"mid": mid, "spread": F.col("ask") - F.col("bid")})
        .withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(F.min_by("mid", F.struct("ts", "mid")).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", F.struct("ts", "mid")).alias("close"), F.avg("spread").alias("spread"), F.count("*").alias("quotes"))
        .select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("closed_at"), "open", "high", "low", "close", "spread", "quotes")
    )


def last_bars(bars: DataFrame, n: int = 600) -> DataFrame:
    """Bounded history: the last n bars of each symbol."""
    from pyspark.sql import Window

    return bars.withColumn("__i", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("__i") <= n).drop("__i")


def fresh(quotes: DataFrame, now, seconds: int = 120) -> DataFrame:
    """Quotes young enough to act on."""
    return quotes.where(F.col("ts") >= now - F.expr(f"interval {seconds} seconds"))


def distinct_alerts(alerts: DataFrame, within: str = "1 day") -> DataFrame:
    """One alert for each id within the watermark."""
    return alerts.withWatermark("ts", within).dropDuplicatesWithinWatermark(["alert_id"])


def keyed_sink(spark: SparkSession, path: str, keys: tuple[str, ...]):
    """A foreachBatch function that appends the rows of a batch whose keys the table does not hold: a replayed batch adds nothing.
    A row of a key that the batch or the table holds with other values is a revision: the batch is refused and nothing written.

    The table is partitioned by nothing and each batch adds files; a key is written once however often its batch runs.
    """

    def write(batch: DataFrame, _epoch: int) -> None:
        try:
            held = spark.read.parquet(path).select(*batch.columns)
        except Exception as e:  # the table does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            held = None
        new = batch.distinct()
        every = new if held is None else new.union(held.join(new.select(*keys).distinct().alias("n"), [held[k].eqNullSafe(F.col(f"n.{k}")) for k in keys], "left_semi"))
        revised = every.distinct().groupBy(*keys).count().where("count > 1").drop("count").first()
        if revised is not None:
            raise ValueError(f"revision refused: {revised.asDict()} has different values")
        if held is not None:
            old = held.select(*keys).distinct().alias("o")
            new = new.join(old, [new[k].eqNullSafe(F.col(f"o.{k}")) for k in keys], "left_anti")
        new.write.mode("append").parquet(path)

    return write


def quotes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the form of quote_stream()."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") * 0.9999).alias("bid"), (F.col("value") * 1.0001).alias("ask"))
