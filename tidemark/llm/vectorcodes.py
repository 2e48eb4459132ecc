"""Compression of vectors into codes of four bytes, one for each quarter of a vector.

Components become whole numbers (1024ths, floored). Each part position has a codebook of up to 256 entries, which begins as that part
of the vectors of the smallest ids and is improved by rounds: every part goes to its nearest entry (lower index on ties), and each
entry becomes the floored mean of its parts; unused entries stay. All sums are of integers, so results do not hang on their order.

Nearest entries are found by a ball tree over the entries of a part position, searched by branch and bound: a ball is left out only
where the distance to its centre less its radius, both rounded against leaving it out, exceeds the best distance so far; balls at equal
distance are visited, as a lower index may lie there, and candidates are compared in whole numbers.

Rows whose vector is null or has null or non-finite components are dropped. A vector whose length is not that of the first one (by id),
or is no multiple of the parts, or whose components leave +-2^26 1024ths (where sums of squares could leave 64 bits) teaches nothing
and has a null code and error. Null ids come last, repeated ids go by their components. Fewer than 256 vectors give fewer entries.
An empty table gives an empty one. Other columns may have any names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, cut, frugal

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
#: Largest component in 1024ths: squares of differences of 512 components still add up within 64 bits.
LIMIT = 1 << 26
#: Entries in a leaf of a ball tree.
LEAF = 8
#: Relative room for rounding in bounds; distances in doubles err by far less.
ROOM = 1e-9
#: Vectors that a task searches at once.
STEP = 8192
#: Over how many salts the rows of one label are spread when their label's sum is joined to them.
SALTS = 32


@dataclass
class Ball:
    entries: np.ndarray
    centre: np.ndarray
    radius: float
    kids: list[Ball] = field(default_factory=list)


def ball(book: np.ndarray, entries: np.ndarray) -> Ball:
    """The tree over the entries of a codebook: halves along the line between two far entries, down to leaves."""
    points = book[entries].astype(float)
    centre = points.mean(axis=0) if points.size else np.zeros(book.shape[1])
    away = np.sqrt(((points - centre) ** 2).sum(axis=1))
    out = Ball(entries, centre, float(away.max(initial=0.0)) * (1 + ROOM) + ROOM)
    if len(entries) > LEAF and away.max() > 0:
        one = points[away.argmax()]
        other = points[((points - one) ** 2).sum(axis=1).argmax()]
        order = np.argsort(points @ (other - one), kind="stable")
        half = len(order) // 2
        out.kids = [ball(book, entries[np.sort(order[:half])]), ball(book, entries[np.sort(order[half:])])]
    return out


def trees(books: np.ndarray) -> list[Ball]:
    return [ball(b, np.arange(len(b))) for b in books]


def nearest(tree: Ball, book: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part (lower on ties) and the squared distance. Parts walk the tree in groups that agree on
    which ball is nearer; a group leaves out a ball for those of its parts for which nothing in it can be as near as what they have."""
    exact = parts.astype(np.int64)
    rough = parts.astype(float)
    best = np.full(len(parts), np.iinfo(np.int64).max)
    index = np.full(len(parts), -1, np.int64)

    def apart(node: Ball, rows: np.ndarray) -> np.ndarray:
        d = rough[rows] - node.centre
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    waiting = [(tree, np.arange(len(parts)), apart(tree, np.arange(len(parts))))]
    while waiting:
        node, rows, away = waiting.pop()
        bound = np.maximum(away * (1 - ROOM) - node.radius, 0.0)
        near = bound * bound * (1 - ROOM) <= best[rows] * (1 + ROOM)
        rows = rows[near]
        if not len(rows):
            continue
        if not node.kids:
            x, b, i = exact[rows], best[rows], index[rows]
            for e in node.entries:
                d = x - book[e]
                d2 = np.einsum("ij,ij->i", d, d)
                better = (d2 < b) | ((d2 == b) & (e < i))
                b, i = np.where(better, d2, b), np.where(better, e, i)
            best[rows], index[rows] = b, i
            continue
        left, right = node.kids
        to_left, to_right = apart(left, rows), apart(right, rows)
        for group, order in ((to_left <= to_right, (right, left)), (to_left > to_right, (left, right))):
            for kid in order:  # the nearer one is taken from the end first
                waiting.append((kid, rows[group], (to_left if kid is left else to_right)[group]))
    return index, best


def _arrays(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch without nulls as rows."""
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _assign(books: np.ndarray, search: list[Ball], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each vector (rows) and part (columns)."""
    parts = vectors.reshape(len(vectors), len(books), -1)
    found = [nearest(search[p], books[p], np.ascontiguousarray(parts[:, p])) for p in range(len(books))]
    return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and v (array<int>, null where it can't be coded) of the rows kept."""
    x = F.transform(F.col(vector), lambda c: c.cast("double") * SCALE)
    finite = F.forall(F.col(vector), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    whole = F.transform("x", lambda c: F.floor(c).cast("int"))
    rows = vectors.where(F.col(vector).isNotNull() & finite).select(F.col(key).alias("vec_id"), F.col(label).alias("label"), x.alias("x"))
    return rows.select("vec_id", "label", F.when(F.forall("x", lambda c: F.abs(c) <= LIMIT), whole).alias("v"))


def _sums(rows: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, dict[int, int]]]:
    """Counts and sums of the parts at each entry: (part, entry) -> count, sums by place. As many numbers as the codebooks have."""
    width = books.shape[0] * books.shape[2]
    shared = rows.sparkSession.sparkContext.broadcast(books)

    @frugal
    def run(batches):
        books = shared.value
        parts, entries, d = books.shape
        search = trees(books)
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, d), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                v = _arrays(batch.slice(start, STEP), width)
                index, _ = _assign(books, search, v)
                for p in range(parts):
                    counts[p] += np.bincount(index[:, p], minlength=entries)
                    np.add.at(sums[p], index[:, p], v[:, p * d : (p + 1) * d])
        at = np.argwhere(counts > 0)
        columns = [pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(counts[counts > 0], pa.int64()), pa.array(list(sums[counts > 0]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "s"])

    found = rows.select("v").mapInArrow(run, "part int, entry int, n long, s array<long>")
    merged = found.select("part", "entry", "n", F.posexplode("s").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out: dict = {}
    for r in merged.collect():
        out.setdefault((r["part"], r["entry"]), (r["n"], {}))[1][r["place"]] = r["x"]
    shared.destroy()
    return out


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, components) of rows (vec_id, v). Empty without a vector that can be coded."""
    known = rows.where("v is not null").select("vec_id", "v")
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = known.orderBy(*order).limit(1).collect()
    width = len(first[0]["v"]) if first else 0
    if not width or width % parts:
        return np.zeros((parts, 0, 0), np.int64)
    known = known.where(F.size("v") == width)
    head = np.array([r["v"] for r in known.orderBy(*order).limit(entries).collect()], np.int64)
    books = np.ascontiguousarray(head.reshape(len(head), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = books.copy()
        for (p, e), (n, s) in _sums(known, books).items():
            books[p, e] = [s[i] // n for i in range(books.shape[2])]
    return books


def assign(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of rows (vec_id, label, v)."""
    width = books.shape[0] * books.shape[2] if books.size else -1
    shared = rows.sparkSession.sparkContext.broadcast(books)

    @frugal
    def run(batches):
        books = shared.value
        search = trees(books)
        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                batch = whole.slice(start, STEP)
                index, d2 = _assign(books, search, _arrays(batch, width))
                code = pa.array([bytes(r).hex() for r in index.astype(np.uint8)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code, pa.array(d2.sum(axis=1), pa.int64())], ["vec_id", "label", "code", "error"])

    types = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    other = rows.where(F.col("v").isNull() | (F.size("v") != width)).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return other if width < 0 else rows.where(F.size("v") == width).mapInArrow(run, types).unionByName(other)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, nulls together) and the codebooks' digest."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits: 1 to 256 entries")
    bounded_batches(vectors.sparkSession)
    rows = cut(integers(vectors, key, vector, label), "vectors")
    books = fit(rows, parts, entries, rounds)
    coded = cut(assign(rows, books), "codes")
    # A label may hold any share of the rows: its sum is copied to all salts, and its rows meet the copy of theirs.
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("its"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("its_salt"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(sums, F.col("label").eqNullSafe(F.col("its")) & (F.col("salt") == F.col("its_salt")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
