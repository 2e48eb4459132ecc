"""Bars that stay open to late ticks, and feeds that fall silent, as a stateful stream.

State by symbol: its bars until they are final, and its newest tick. A tick that comes after its bar has ended (a newer bar's tick was seen before) amends the bar and emits the
bar before and after it. When the watermark has passed a bar's end by the quiet time, the bar is final: it is emitted and leaves the state. If no bar began within that time the feed fell
silent: one alert an episode, keyed by the last bar. Ticks of bars that the watermark has made final are too late and are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

VALUES = ("open", "high", "low", "close")
OUT = "symbol string, kind string, bar long, event_id long, ticks long, was_ticks long, " + ", ".join(f"{p}{c} double" for p in ("", "was_") for c in VALUES)
BAR = "open double, high double, low double, close double, first_at long, first_id long, last_at long, last_id long, ticks long"
MICROS = 1_000_000


class Revisions(StatefulProcessor):
    def __init__(self, width: int, quiet: int):
        """Seconds of a bar, and of silence; quiet is a multiple of width."""
        if width <= 0 or quiet <= 0 or quiet % width:
            raise ValueError("quiet has to be a multiple of width")
        self.width, self.quiet = width * MICROS, quiet * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "bar long", BAR)
        self.newest = handle.getValueState("newest", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        ticks = pd.concat(list(rows)).sort_values(["at", "event_id"])
        newest = self.newest.get()[0] if self.newest.exists() else None
        mark = timerValues.getCurrentWatermarkInMs()
        held: dict[int, tuple | None] = {}
        out = []
        for at, event, price in zip(ticks["at"].tolist(), ticks["event_id"].tolist(), ticks["price"].tolist()):
            bar = at // self.width * self.width
            if (bar + self.width + self.quiet) // 1000 <= mark:
                continue  # too late: the bar is final, or is about to be
            if bar not in held:
                held[bar] = tuple(self.bars.getValue((bar,))) if self.bars.containsKey((bar,)) else None
            was = held[bar]
            now = held[bar] = self.amended(was, at, event, price)
            if newest is not None and newest >= bar + self.width:
                out.append((key[0], "revised", bar, event, now[8], was[8] if was else 0, *now[:4], *(was[:4] if was else (None,) * 4)))
            newest = at if newest is None else max(newest, at)
        for bar, value in held.items():
            self.bars.updateValue((bar,), value)
            self.handle.registerTimer((bar + self.width + self.quiet) // 1000)
        if newest is not None:
            self.newest.update((newest,))
        yield self.frame(out)

    @staticmethod
    def amended(was: tuple | None, at: int, event: int, price: float) -> tuple:
        if was is None:
            return (price, price, price, price, at, event, at, event, 1)
        opened, high, low, closed, first_at, first_id, last_at, last_id, n = was
        if (at, event) < (first_at, first_id):
            opened, first_at, first_id = price, at, event
        if (at, event) > (last_at, last_id):
            closed, last_at, last_id = price, at, event
        return (opened, max(high, price), min(low, price), closed, first_at, first_id, last_at, last_id, n + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        bar = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.quiet - self.width
        if not self.bars.containsKey((bar,)):
            return
        now = tuple(self.bars.getValue((bar,)))
        out = [(key[0], "final", bar, None, now[8], None, *now[:4], *(None,) * 4)]
        if not any(self.bars.containsKey((bar + k * self.width,)) for k in range(1, self.quiet // self.width + 1)):
            out.append((key[0], "stale", bar, None, *(None,) * 10))
        self.bars.removeKey((bar,))
        yield self.frame(out)

    @staticmethod
    def frame(rows: list):
        import pandas as pd

        names = [f.split()[0] for f in OUT.split(", ")]
        df = pd.DataFrame(rows, columns=names)
        for c in ("bar", "event_id", "ticks", "was_ticks"):
            df[c] = df[c].astype("Int64")
        return df

    def close(self) -> None:
        pass


def revisions(ticks: DataFrame, width: int = 300, quiet: int = 3600, late: str = "1 day") -> DataFrame:
    """Stream of symbol, kind (revised, final, stale), bar and the values now and before, of a stream of ticks (symbol, ts, event_id, price) that come up to late behind the newest one. The session
    needs a state store with column families (RocksDB)."""
    keyed = ticks.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late).groupBy("symbol")
    out = keyed.transformWithStateInPandas(Revisions(width, quiet), OUT, "append", "eventTime")
    return out.withColumn("bar", F.timestamp_micros("bar").cast("timestamp_ntz"))


def stateful_session(spark: SparkSession, partitions: int = 4) -> SparkSession:
    """A session of the same application for stateful streams, so that the caller's settings stay as they are."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def write_arrivals(rows: DataFrame, folder: str, arrival: str) -> None:
    """Write rows as one file for each value of arrival (whole numbers), whose times put them in that order, so that a stream of the folder with a file a trigger replays them."""
    rows.repartition(F.col(arrival)).write.partitionBy(arrival).mode("append").parquet(folder)
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for d in store.listStatus(root):
        name = d.getPath().getName()
        if name.startswith(f"{arrival}="):
            for f in store.listStatus(d.getPath()):
                if f.getPath().getName().endswith(".parquet"):
                    store.setTimes(f.getPath(), 1_700_000_000_000 + 1000 * int(name.split("=")[1]), -1)


def replayed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The stream of a folder of arrivals, a file a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("maxFileAge", "36500d").parquet(folder)


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append all that the stream yields until its source has nothing more."""
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
