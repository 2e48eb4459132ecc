"""A drained stream gives the bars of the batch, but for the last open one; a replayed batch adds nothing."""

from pyspark.sql import functions as F

from tidemark.streaming import bars as streaming

SF = "/root/testdata/sf0.001"


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    quotes = streaming.quotes_table(spark, SF).orderBy("ts")
    days = [r[0] for r in quotes.select(F.to_date("ts").alias("d")).distinct().orderBy("d").limit(6).collect()]
    for i, d in enumerate(days):
        quotes.where(F.to_date("ts") == F.lit(d)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streaming.stream_bars(streaming.quote_stream(spark, f"{tmp_path}/in", 2), "4 hours", "10 days")
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    late = streaming.stream_bars(streaming.quote_stream(spark, f"{tmp_path}/in", 10), "4 hours", "1 second")
    query = late.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out2").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.symbol, r.ts): r for r in spark.read.parquet(f"{tmp_path}/out2").collect()}
    want = {(r.symbol, r.ts): r for r in streaming.stream_bars(spark.read.parquet(f"{tmp_path}/in"), "4 hours").collect()}
    end = max(r.closed_at for r in want.values())
    closed = {k: r for k, r in want.items() if r.closed_at < end}
    assert closed and {k: r for k, r in got.items() if k in closed} == closed


def test_replayed_batches_add_nothing(spark, tmp_path):
    write = streaming.keyed_sink(spark, f"{tmp_path}/t", ("account", "session"))
    batch = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("a", 2, 6.0)], "account string, session int, v double")
    write(batch, 0)
    write(batch, 0)
    write(batch.unionByName(spark.createDataFrame([("b", 1, 1.0)], batch.schema)), 1)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3


def test_history_and_freshness(spark):
    df = spark.range(10).select(F.lit("A").alias("symbol"), F.timestamp_seconds("id").alias("ts"))
    assert {r.ts.second for r in streaming.last_bars(df, 3).collect()} == {7, 8, 9}
    assert streaming.fresh(df, F.timestamp_seconds(F.lit(9)), 4).count() == 5
