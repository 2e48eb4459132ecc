"""Chunk files of five-minute bars with a manifest: a sink, and a data source that verifies what it reads.

A folder holds manifest.json and one Parquet file a symbol, side and stretch of time. The manifest says of each chunk its file, rows, first
and last bar and SHA-256. The source has a partition for each chunk: chunks whose stretch lies outside the asked times, or of
other symbols or sides, become no partition and are never opened; the others are hashed and counted as they are read. A chunk that is
missing, damaged, of another length, unlisted, or that holds impossible prices is an error that names it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

PRICES = ("open", "high", "low", "close")
SCHEMA = "symbol string, side string, ts timestamp, open double, high double, low double, close double"
SIDES = ("BID", "ASK")
BAR_SECONDS = 300
_ARROW = pa.schema([("symbol", pa.string()), ("side", pa.string()), ("ts", pa.timestamp("us", "UTC")), *[(c, pa.float64()) for c in PRICES]])


class ChunkError(ValueError):
    """What the manifest says and what the folder holds differ."""


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a folder's URI, or of the plain path of a local one."""
    if "://" not in folder and ":/" not in folder:
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _read(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_file(path) as f:
        return f.read()


def _time(text: str) -> dt.datetime:
    at = dt.datetime.fromisoformat(text)
    return at.replace(tzinfo=dt.timezone.utc) if at.tzinfo is None else at


# Sink


def write_chunks(bars: DataFrame, folder: str, days: int = 7, overlap: int = 1) -> None:
    """Write bars (SCHEMA) as chunks of so many days, each with the first overlap bars of the next stretch as well, as a downloader that asks again for its
    last bars leaves them. Each task writes the chunks of its groups and hands on their entries; the manifest comes last, so that a folder without one is unfinished."""
    stretch = F.floor(F.unix_seconds("ts") / (days * 86_400))
    rank = F.expr(f"row_number() OVER (PARTITION BY symbol, side, floor(unix_seconds(ts) / {days * 86_400}) ORDER BY ts)")
    homes = F.when(rank <= overlap, F.array(stretch, stretch - 1)).otherwise(F.array(stretch))
    dealt = bars.withColumn("__homes", homes).withColumn("__stretch", F.explode("__homes")).drop("__homes")
    # a stretch that holds nothing but the first bars of the next one is no chunk
    own = F.max(F.when(stretch == F.col("__stretch"), True)).over(_by("symbol", "side", "__stretch"))
    dealt = dealt.withColumn("__own", own).where("__own").drop("__own")

    def write(group: pa.Table) -> pa.Table:
        store, root = _open(folder)
        symbol, side, number = (group.column(c)[0].as_py() for c in ("symbol", "side", "__stretch"))
        rows = group.sort_by("ts").select(["ts", *PRICES])
        sink = io.BytesIO()
        pq.write_table(rows, sink, row_group_size=4096)
        data, name = sink.getvalue(), f"{symbol}/{side}_M5_{number:06d}.parquet"
        store.create_dir(f"{root}/{symbol}", recursive=True)
        with store.open_output_stream(f"{root}/{name}") as f:  # a repeated task writes the same bytes again
            f.write(data)
        first, last = (rows.column("ts")[i].as_py().astimezone(dt.timezone.utc).isoformat() for i in (0, -1))
        return pa.table({"symbol": [symbol], "side": [side], "file": [name], "rows": pa.array([len(rows)], pa.int64()), "first": [first], "last": [last], "sha256": [hashlib.sha256(data).hexdigest()]})

    entries = dealt.groupBy("symbol", "side", "__stretch").applyInArrow(write, "symbol string, side string, file string, rows long, first string, last string, sha256 string")
    chunks = [r.asDict() for r in entries.orderBy("file").collect()]
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"complete": True, "upsampled": False, "bar_size": "5 mins", "chunks": chunks}, indent=1).encode())


def _by(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


# Source


@dataclass
class Chunk(InputPartition):
    symbol: str
    side: str
    file: str
    rows: int
    first: str
    last: str
    sha256: str


def load_manifest(folder: str) -> list[Chunk]:
    """The chunks of a finished download of five-minute bars."""
    store, root = _open(folder)
    if store.get_file_info(f"{root}/manifest.json").type != fs.FileType.File:
        raise ChunkError(f"{folder}/manifest.json is missing: the download is not finished")
    said = json.loads(_read(store, f"{root}/manifest.json"))
    if said.get("complete") is not True:
        raise ChunkError("the manifest is not complete")
    if said.get("upsampled") is not False or said.get("bar_size") != "5 mins":
        raise ChunkError("the manifest is not of genuine five-minute bars")
    return [Chunk(**c) for c in said["chunks"]]


def check_listing(folder: str, chunks: list[Chunk]) -> None:
    """Every listed file is there, none is unlisted, and every symbol has both sides."""
    store, root = _open(folder)
    found = {f.path.removeprefix(root.rstrip("/") + "/").removeprefix(root.strip("/") + "/") for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith(".parquet")}
    listed = {c.file for c in chunks}
    if listed - found:
        raise ChunkError(f"chunks of the manifest are missing: {sorted(listed - found)}")
    if found - listed:
        raise ChunkError(f"chunk files that the manifest does not list: {sorted(found - listed)}")
    for symbol in {c.symbol for c in chunks}:
        for side in SIDES:
            if not any(c.symbol == symbol and c.side == side for c in chunks):
                raise ChunkError(f"no {side} chunks for {symbol}")


def verified(folder: str, chunk: Chunk) -> pa.Table:
    """The rows of a chunk, if its bytes, their number and their prices are sound."""
    store, root = _open(folder)
    data = _read(store, f"{root}/{chunk.file}")
    if hashlib.sha256(data).hexdigest() != chunk.sha256:
        raise ChunkError(f"SHA-256 of {chunk.file} differs from the manifest")
    rows = pq.read_table(io.BytesIO(data))
    if len(rows) != chunk.rows:
        raise ChunkError(f"{chunk.file} has {len(rows)} rows and not {chunk.rows}")
    prices = [rows.column(c).cast(pa.float64()) for c in PRICES]
    sound = pc.and_(pc.greater_equal(prices[1], pc.max_element_wise(*prices, skip_nulls=False)), pc.less_equal(prices[2], pc.min_element_wise(*prices, skip_nulls=False)))
    for p in prices:
        sound = pc.and_(sound, pc.and_(pc.is_finite(p), pc.greater(p, 0.0)))
    if not pc.all(pc.fill_null(sound, False), min_count=0).as_py():
        raise ChunkError(f"{chunk.file} holds impossible prices")
    seconds = pc.divide(pc.cast(pc.cast(rows.column("ts"), pa.timestamp("us", "UTC")), pa.int64()), 1_000_000)
    if not pc.all(pc.equal(seconds, pc.multiply(pc.divide(seconds, BAR_SECONDS), BAR_SECONDS)), min_count=0).as_py():
        raise ChunkError(f"{chunk.file} holds bars off the five-minute grid")
    return rows


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.start, self.end = (_time(options[k]) if options.get(k) else None for k in ("start", "end"))
        self.symbols = set(options["symbols"].split(",")) if options.get("symbols") else None
        self.sides = set(options["sides"].split(",")) if options.get("sides") else None
        self.check = options.get("check", "true") == "true"

    def wanted(self, chunk: Chunk) -> bool:
        return (
            (self.symbols is None or chunk.symbol in self.symbols)
            and (self.sides is None or chunk.side in self.sides)
            and (self.end is None or _time(chunk.first) < self.end)
            and (self.start is None or _time(chunk.last) >= self.start)
        )

    def partitions(self) -> list[InputPartition]:
        chunks = load_manifest(self.folder)
        if self.check:
            check_listing(self.folder, chunks)
        return [c for c in chunks if self.wanted(c)] or [Chunk("", "", "", 0, "", "", "")]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        rows = verified(self.folder, partition)
        at = rows.column("ts").cast(pa.timestamp("us", "UTC"))
        keep = pc.is_valid(at)
        if self.start is not None:
            keep = pc.and_(keep, pc.greater_equal(at, pa.scalar(self.start, pa.timestamp("us", "UTC"))))
        if self.end is not None:
            keep = pc.and_(keep, pc.less(at, pa.scalar(self.end, pa.timestamp("us", "UTC"))))
        rows = rows.set_column(rows.schema.get_field_index("ts"), "ts", at).filter(keep)
        n = len(rows)
        columns = [pa.array([partition.symbol] * n, pa.string()), pa.array([partition.side] * n, pa.string()), rows.column("ts"), *[rows.column(c).cast(pa.float64()) for c in PRICES]]
        yield from pa.table(columns, schema=_ARROW).to_batches(max_chunksize=65_536)


class PushedReader(ChunkReader):
    """A reader that takes filters, which Spark allows only where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Times, symbols and sides prune chunks; all filters go back to Spark, as a chunk reaches beyond the asked times."""
        for f in filters:
            if f.__class__ in (EqualTo, In) and f.attribute in (("symbol",), ("side",)):
                name = "symbols" if f.attribute == ("symbol",) else "sides"
                asked, held = set(f.value) if isinstance(f, In) else {f.value}, getattr(self, name)
                setattr(self, name, asked if held is None else held & asked)
            elif f.__class__ in (GreaterThan, GreaterThanOrEqual, EqualTo) and f.attribute == ("ts",):
                self.start = max(filter(None, (self.start, _aware(f.value))))
            if f.__class__ in (LessThan, LessThanOrEqual, EqualTo) and f.attribute == ("ts",):
                # end is exclusive: one step beyond, where the value itself may count
                beyond = _aware(f.value) + (dt.timedelta(0) if isinstance(f, LessThan) else dt.timedelta(microseconds=1))
                self.end = min(filter(None, (self.end, beyond)))
            yield f


def _aware(at: dt.datetime) -> dt.datetime:
    return at.replace(tzinfo=dt.timezone.utc) if at.tzinfo is None else at.astimezone(dt.timezone.utc)


class ChunkSource(DataSource):
    """format("bar_chunks"): options path, start, end (ISO, end exclusive), symbols and sides (comma-separated), check (whether the whole
    folder is compared with the manifest), pushdown (whether filters prune as well, where the session allows it)."""

    @classmethod
    def name(cls) -> str:
        return "bar_chunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (PushedReader if options.get("pushdown") == "true" else ChunkReader)(options)


def read_chunks(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None, symbols: tuple[str, ...] = (), sides: tuple[str, ...] = ()) -> DataFrame:
    """Verified bars of start <= ts < end. Bars that chunks share appear once; bars that differ at one time are an error, as no rule prefers either."""
    spark.dataSource.register(ChunkSource)
    asked = {"path": folder, "start": start, "end": end, "symbols": ",".join(symbols), "sides": ",".join(sides)}
    rows = spark.read.format("bar_chunks").options(**{k: v for k, v in asked.items() if v}).load().distinct()
    n = F.count("*").over(_by("symbol", "side", "ts"))
    return rows.withColumn("__n", n).select(*[F.when(F.col("__n") == 1, F.col(c)).otherwise(F.raise_error(F.concat(F.lit("chunks differ at "), F.col("ts").cast("string")))).alias(c) if c == "open" else F.col(c) for c in rows.columns])


def both_sides(rows: DataFrame, floor: float = 0.0) -> DataFrame:
    """Bid and ask of the times that both have, with the ask raised where the spread is below the floor."""
    side = lambda s: rows.where(F.col("side") == s).select("symbol", "ts", *[F.col(c).alias(f"{s.lower()}_{c}") for c in PRICES])
    joined = side("BID").join(side("ASK"), ["symbol", "ts"])
    return joined.withColumns({f"ask_{c}": F.greatest(f"ask_{c}", F.col(f"bid_{c}") + floor) for c in PRICES})


def replay_window(spark: SparkSession, folder: str, start: str, end: str, floor: float = 0.0) -> DataFrame:
    """Bid and ask of start <= ts < end. No chunk there is an error, and so is a symbol of the manifest without bars of either side."""
    chunks = load_manifest(folder)
    if not any(_time(c.first) < _time(end) and _time(c.last) >= _time(start) for c in chunks):
        raise ChunkError("no chunks in the window")
    return both_sides(read_chunks(spark, folder, start, end), floor)


def chunk_report(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each chunk of the manifest, and for each file that it does not list: what is said, what is found, and the problem (null where there is
    none). Files are hashed by the tasks that read them."""
    said = spark.createDataFrame([vars(c) for c in load_manifest(folder)], "symbol string, side string, file string, rows long, first string, last string, sha256 string")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    file = F.regexp_extract("path", "([^/]+/[^/]+)$", 1)

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("found_sha256"), pa.array([_rows(x.as_buffer()) for x in b.column("content")], pa.int64())], ["file", "found_sha256", "found_rows"])

    measured = found.select(file.alias("file"), F.sha2("content", 256).alias("found_sha256"), "content").mapInArrow(count, "file string, found_sha256 string, found_rows long")
    both = said.join(measured, "file", "full_outer")
    problem = F.when(F.col("rows").isNull(), "unlisted").when(F.col("found_sha256").isNull(), "missing").when(F.col("sha256") != F.col("found_sha256"), "hash").when(~F.col("rows").eqNullSafe(F.col("found_rows")), "rows")
    return both.withColumn("problem", problem)


def _rows(data: pa.Buffer) -> int | None:
    try:
        return pq.read_metadata(pa.BufferReader(data)).num_rows
    except (pa.ArrowInvalid, OSError):
        return None  # not Parquet at all
