"""Shared folder, tables that cut lineage, and small text helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of alphanumerics: every other ASCII character separates, ASCII capitals fold, the rest stays.
ALNUM_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Words between white space.
SPACE_SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def _fold_table(separators: bytes) -> bytes:
    """Byte table: A-Z to a-z, separators to a space. UTF-8 bytes of other characters map to themselves."""
    table = bytearray(range(256))
    for b in separators:
        table[b] = 0x20
    for b in range(0x41, 0x5B):
        table[b] = b + 0x20
    return bytes(table)


ALNUM_FOLD = _fold_table(ALNUM_SEPARATORS)
SPACE_FOLD = _fold_table(SPACE_SEPARATORS)
ASCII_LOWER = _fold_table(b"")


def words_of(text: bytes | None, fold: bytes) -> list[bytes]:
    """Folded words of a UTF-8 text; a null text has none. Only spaces are left as ASCII separators, so split(b" ")
    and not split() decides, which would also cut at separators that the table keeps."""
    if not text:
        return []
    return [w for w in text.translate(fold).split(b" ") if w]


class Places(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = place = len(self)
        return place


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session without executors of
    its own (local[n], as in tests) sets a folder; on a cluster it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(spark, "_tidemark_shared", None)
        if path is None:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
            spark._tidemark_shared = path
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lost executors recompute nothing before it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that a finished step no longer reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """The tables of one run in the shared folder, by name. A table goes when another of its name has been written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}
        self.catalogued: dict[str, str] = {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back, so that lost executors recompute nothing before it."""
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, keys: list[str]) -> DataFrame:
        """Write df without repeats of its keys, in as many buckets of them as a shuffle has partitions: joins on the keys then
        read it in place. It stands in the session's catalog until it is dropped."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path, table = fresh_path(self.spark, name), f"tidemark_{name}_{uuid.uuid4().hex}"
        once = df.repartition(buckets, *keys).dropDuplicates(keys)
        once.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
        self.drop(name)
        self.paths[name], self.catalogued[name] = path, table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.catalogued:
                self.spark.sql(f"DROP TABLE {self.catalogued.pop(name)}")
            if name in self.paths:
                drop_path(self.spark, self.paths.pop(name))

    def keep(self, *names: str) -> None:
        """Delete all tables but these, which the result still reads."""
        self.drop(*(x for x in [*self.paths] if x not in names))


def give_back() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def frugal(run: Callable) -> Callable:
    """run for mapInArrow, after which the worker, which Spark uses again, gives freed memory back to the system."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def space_words(text: Column) -> Column:
    """Number of white-space separated words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def bounded_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Let Spark close Arrow batches at so many bytes, unless the session says otherwise: rows may be very long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("b")) > 256 << 20:
        spark.conf.set(key, str(limit))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow where each task builds its state once: make() gives the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch):
                yield step(part)

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Bytes of input that a step holds at once; longer batches are cut between rows.
BATCH_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, int(rows * limit / max(1, batch.nbytes))) if batch.nbytes > limit else rows
    for start in range(0, rows, step):
        yield batch.slice(start, step)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def ascii_only(text: bytes) -> bool:
    return text.isascii()


def code_point_offsets(text: bytes, positions: list[int]) -> list[int]:
    """Byte positions of a UTF-8 text, ascending or not, as code points."""
    if text.isascii() or not positions:
        return list(positions)
    begins = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.r_[0, np.cumsum(begins)][positions].tolist()

