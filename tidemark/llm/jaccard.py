"""N-gram Jaccard join: documents whose shingle sets are alike, and the components of their links.

The overlaps of all pairs are the product of the document by n-gram incidence matrix with its transpose. It is taken in blocks,
and only for pairs whose sizes and places still allow the threshold:

1. Documents with equal sets become one node (size and a 64-bit hash of the set), so copies are never paired.
2. Shingles are ordered by how often they occur in all documents, counted in SLOTS hashed slots. Two sets that link share a
   shingle among the first ``n - ceil(t n) + 1`` of either, so just these entries are dealt by shingle (column). Where a pair meets in
   its first shared shingle, at places i and j, its overlap is 1 + min(n - 1 - i, m - 1 - j) at most; a pair whom no column
   lets reach the overlap that its sizes ask for is discarded.
3. A column with up to SMALL nodes gives its pairs at once. The nodes of larger columns are multiplied in square blocks of up to
   SIDE nodes with their signatures (parities of the sets over as many bits as the size class asks for, whose distance is a
   lower bound of the sets' distance). A first round takes from each block only a spanning forest of the nearest pairs; once
   its links have merged the nodes, a second takes every pair of different components that signatures let link.
4. The overlaps of the pairs left are accumulated over blocks of n-grams, a node with up to PARTNERS others at a time; a
   pair goes as soon as its count and what remains cannot reach the bound. Links are exact.

Nothing is capped. Null texts and texts without words are empty sets, linked with nothing. A null id is reachable like any
other but smaller than none: a component's id is its smallest id that is not null. Repeated rows are copies. Tables may be
empty. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_FOLD, SPACE_WORD, Scratch, bounded_batches, frugal, slices, utf8, words_of

#: Slots in which occurrences are counted, and kept as a byte each: the table has this size whatever the input, so it may be
#: broadcast.
SLOT_BITS = 22
#: Slots of a row that goes to the sum.
SLICE_BITS = 16
#: Nodes of a column that are paired at once.
SMALL = 16
#: Nodes of a column that a task holds before it passes them on.
HELD = 20_000
#: Nodes on a side of a block of a large column.
SIDE = 4096
#: Partners that a task compares with one node's set.
PARTNERS = 256
#: Blocks of n-grams over which an overlap is accumulated.
GRAM_BLOCKS = 8
#: Parities for each shingle of a signature, before the next power of two, and the least.
PARITIES, LEAST_PARITIES = 8, 512
#: Documents up to which their ids are found by a broadcast filter of 32 bits each; beyond, a join finds them.
FILTER_IDS = 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_NO_ID = 0x5BD1E995


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX2
    return h ^ (h >> np.uint64(27))


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles of n words; with fewer words the whole sequence is one."""
    words = words_of(text, SPACE_FOLD)
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = _mixed((h + w[k : k + len(h)]) * _MIX)
    return np.unique(h)


def set_hash(shingles: np.ndarray) -> int:
    """Signed 64 bits of a set."""
    h = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return h - (1 << 64) if h >> 63 else h


def least_overlap(n, m, percent: int):
    """Shared shingles that sets of n and m shingles need to link."""
    return -(-percent * (n + m) // (100 + percent))


def _profile(docs: DataFrame, n: int) -> DataFrame:
    """A row (kind 0) with size and hash of each document's set, rows (kind 1) with each task's counts of a slice of slots."""

    def rows(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns, ["kind", "doc_id", "text_hash", "n", "h", "counts"])

    @frugal
    def run(batches):
        counts = np.zeros(1 << SLOT_BITS, np.uint32)
        pack = zstandard.ZstdCompressor(level=1).compress
        for whole in batches:
            for batch in slices(whole):
                m = batch.num_rows
                sizes, hashes = np.zeros(m, np.int32), np.zeros(m, np.int64)
                for i, text in enumerate(utf8(batch.column(2))):
                    s = shingle_set(text, n)
                    sizes[i], hashes[i] = len(s), set_hash(s)
                    np.add.at(counts, (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
                yield rows([pa.array(np.zeros(m, np.int32)), batch.column(0), batch.column(1), pa.array(sizes), pa.array(hashes), pa.nulls(m, pa.binary())])
        for i in range(1 << (SLOT_BITS - SLICE_BITS)):
            part = counts[i << SLICE_BITS : (i + 1) << SLICE_BITS]
            if part.any():
                yield rows([pa.array([1], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([i], pa.int32()), pa.nulls(1, pa.int64()), pa.array([pack(part.tobytes())])])

    return docs.mapInArrow(run, "kind int, doc_id long, text_hash long, n int, h long, counts binary")


def _occurrences(profile: DataFrame) -> np.ndarray:
    """Eighths of the binary logarithm of the slots' counts over all documents, up to 255, summed in as many streams as there are
    slices."""

    def row(at, total) -> pa.RecordBatch:
        level = np.minimum(255, np.floor(8 * np.log2(1.0 + total))).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([level.tobytes()])], ["n", "counts"])

    @frugal
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        at, total = None, None
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(unpack(data), np.uint32)
                if i != at:
                    if at is not None:
                        yield row(at, total)
                    at, total = i, np.zeros(1 << SLICE_BITS, np.uint64)
                total += part
        if at is not None:
            yield row(at, total)

    parts = profile.where("kind = 1").select("n", "counts").repartition(1 << (SLOT_BITS - SLICE_BITS), "n").sortWithinPartitions("n").mapInArrow(run, "n int, counts binary")
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    for r in parts.toLocalIterator():
        out[r["n"] << SLICE_BITS : (r["n"] + 1) << SLICE_BITS] = np.frombuffer(r["counts"], np.uint8)
    return out


def _prefixes(docs: DataFrame, n: int, percent: int, shared) -> DataFrame:
    """``token, n, h, place``: the necessary prefix of each set in order, once for each task that has it."""

    @frugal
    def run(batches):
        counts = shared.value
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            for batch in slices(whole):
                tokens, sizes, nodes, places = [], [], [], []
                for text in utf8(batch.column(0)):
                    s = shingle_set(text, n)
                    key = (len(s), set_hash(s))
                    if not len(s) or key in seen:
                        continue
                    seen.add(key)
                    k = len(s) - -(-percent * len(s) // 100) + 1
                    f = counts[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                    tokens.append(s[np.lexsort((s, f))[:k]])
                    sizes.append(np.full(k, len(s), np.int32))
                    nodes.append(np.full(k, key[1], np.int64))
                    places.append(np.arange(k, dtype=np.int32))
                if tokens:
                    columns = [pa.array(np.concatenate(tokens).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (sizes, nodes, places))]
                    yield pa.RecordBatch.from_arrays(columns, ["token", "n", "h", "place"])

    return docs.select("text").mapInArrow(run, "token long, n int, h long, place int")


def _reach(n, i, m, j, percent: int) -> np.ndarray:
    """Whether sets of n and m shingles, whose first shared one has places i and j, may link."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (1 + np.minimum(n - 1 - i, m - 1 - j) >= least_overlap(n, m, percent))


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Sorted rows without their repeats."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    return rows[new]


def _multiply(prefixes: DataFrame, percent: int) -> DataFrame:
    """Kind 0: pairs (pn, ph) with (n, h) of columns of up to SMALL nodes; kind 1: the rows of larger columns."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)
        large = False  # a part of the first column in held has gone
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)
            held = _distinct(np.concatenate([held, rows]))
            last = np.flatnonzero(held[:, 0] != held[-1, 0]) if len(held) else ()
            if len(last):
                yield from columns(held[: last[-1] + 1], large)
                held, large = held[last[-1] + 1 :], False
            if len(held) > HELD:
                yield emit(1, held[:-1], None)
                held, large = held[-1:], True
        if len(held):
            yield from columns(held, large)

    def columns(rows: np.ndarray, large: bool) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        length = np.diff(np.r_[first, len(rows)])
        many = length > SMALL
        many[0] |= large
        big = np.repeat(many, length)
        if big.any():
            yield emit(1, rows[big], None)
        left, right = [], []
        for d in range(1, SMALL):
            i = np.flatnonzero(~big[:-d] & (rows[d:, 0] == rows[:-d, 0])) if len(rows) > d else np.zeros(0, np.int64)
            left.append(i)
            right.append(i + d)
        a, b = rows[np.concatenate(left)], rows[np.concatenate(right)]
        fit = _reach(a[:, 1], a[:, 3], b[:, 1], b[:, 3], percent)
        pairs = np.unique(np.concatenate([a[fit, 1:3], b[fit, 1:3]], 1), axis=0)
        if len(pairs):
            yield emit(0, pairs[:, 2:], pairs[:, :2])

    def emit(kind: int, rows: np.ndarray, others: np.ndarray | None) -> pa.RecordBatch:
        m = len(rows)
        if kind:
            values = [rows[:, 0], None, None, rows[:, 1], rows[:, 2], rows[:, 3]]
        else:
            values = [None, others[:, 0], others[:, 1], rows[:, 0], rows[:, 1], None]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        arrays = [pa.nulls(m, t) if v is None else pa.array(v).cast(t) for v, t in zip(values, types, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), *arrays], ["kind", "token", "pn", "ph", "n", "h", "place"])

    blocks = max(16, int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = prefixes.repartition(blocks, "token").sortWithinPartitions("token", "n", "h")
    return dealt.mapInArrow(run, "kind int, token long, pn int, ph long, n int, h long, place int")


def signature(shingles: np.ndarray) -> np.ndarray:
    """Parities of a set, as bytes: two sets differ in at least as many shingles as their signatures in bits, also after the longer
    one is folded to the shorter one's length."""
    bits = max(LEAST_PARITIES, 1 << (PARITIES * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def _load(tables: Scratch, docs: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """``n, h, shingles, signature`` of the needed nodes (n, h, doc_id of a document that has the set) and of some others. Up to
    FILTER_IDS nodes, a filter of their ids keeps most other documents from being cut into shingles, beyond that a join does.
    The table is bucketed by node, so that joins with pairs do not shuffle it again."""
    wanted = needed.count()
    shared = None
    if wanted <= FILTER_IDS:
        bits = max(16, (32 * wanted).bit_length())
        place = f"(xxhash64(coalesce(doc_id, {_NO_ID}L)) & {(1 << bits) - 1}L)"
        words = needed.groupBy(F.expr(f"int(shiftright({place}, 5))").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, int({place} & 31))")).alias("b")).toArrow()
        table = np.zeros(1 << (bits - 5), np.uint32)
        table[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
        shared = docs.sparkSession.sparkContext.broadcast(table)
        docs = docs.select("doc_id", "text", F.expr(place).alias("place"))
    else:
        ids = needed.select(F.col("doc_id").alias("named")).distinct()
        docs = docs.join(ids, docs["doc_id"].eqNullSafe(ids["named"]), "left_semi").select("doc_id", "text", F.lit(0).cast("long").alias("place"))

    @frugal
    def sets(batches):
        table = None if shared is None else shared.value
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            for batch in slices(whole):
                if table is not None:
                    at = batch.column(2).to_numpy()
                    batch = batch.filter(pa.array((table[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool)))
                out = []
                for text in utf8(batch.column(1)):
                    s = shingle_set(text, n)
                    key = (len(s), set_hash(s))
                    if len(s) and key not in seen:
                        seen.add(key)
                        out.append((*key, s.tobytes(), signature(s).tobytes()))
                if out:
                    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["n", "h", "shingles", "signature"])

    loaded = docs.mapInArrow(sets, "n int, h long, shingles binary, signature binary")
    written = tables.bucketed(loaded, "loaded", ["n", "h"])
    if shared is not None:
        shared.destroy()
    return written


def shared_shingles(a: np.ndarray, b: np.ndarray, least: int) -> int | None:
    """Overlap of two sorted sets, accumulated over blocks of n-grams; None once it cannot reach least."""
    bounds = np.arange(1, GRAM_BLOCKS, dtype=np.uint64) * np.uint64(2**64 // GRAM_BLOCKS)
    cuts_a, cuts_b = np.r_[0, np.searchsorted(a, bounds), len(a)], np.r_[0, np.searchsorted(b, bounds), len(b)]
    both = 0
    for k in range(GRAM_BLOCKS):
        if both + min(len(a) - cuts_a[k], len(b) - cuts_b[k]) < least:
            return None
        x, y = a[cuts_a[k] : cuts_a[k + 1]], b[cuts_b[k] : cuts_b[k + 1]]
        if len(x) and len(y):
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both += int((y[at] == x).sum())
    return both if both >= least else None


def _links(loaded: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (pn, ph, n, h) whose sets, loaded as n, h, shingles, reach the threshold."""
    sizes = pairs.groupBy("pn", "ph").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / PARTNERS)
    partners = pairs.join(sizes, ["pn", "ph"]).select("n", "h", "pn", "ph", F.pmod(F.col("h"), blocks).cast("int").alias("block"), F.lit(1).alias("kind"))
    centres = sizes.select(F.col("pn").alias("n"), F.col("ph").alias("h"), "pn", "ph", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("block"), F.lit(0).alias("kind"))
    roles = partners.unionByName(centres)

    @frugal
    def accumulate(batches):
        key, centre = None, None
        for whole in batches:
            for batch in slices(whole):
                out = []
                for pn, ph, block, kind, m, h, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = np.frombuffer(data, np.uint64)
                    if kind == 0:
                        key, centre = (pn, ph, block), own
                    elif (pn, ph, block) == key and shared_shingles(own, centre, least_overlap(m, pn, percent)) is not None:
                        out.append((pn, ph, m, h))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64()) * 2, strict=True)], ["pn", "ph", "n", "h"])

    rows = roles.join(loaded.select("n", "h", "shingles"), ["n", "h"]).select("pn", "ph", "block", "kind", "n", "h", "shingles")
    return rows.repartition("pn", "ph", "block").sortWithinPartitions("pn", "ph", "block", "kind").mapInArrow(accumulate, "pn int, ph long, n int, h long")


def _apart(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the rows i of a differ from the rows j of b."""
    out = np.zeros(len(i), np.int64)
    step = max(1, (4 << 20) // max(1, a.shape[1] * 8))
    for at in range(0, len(i), step):
        out[at : at + step] = np.bitwise_count(a[i[at : at + step]] ^ b[j[at : at + step]]).sum(1, dtype=np.int64)
    return out


def near_pairs(n, place, label, marks: list[bytes], left: np.ndarray, percent: int, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a block's rows that sizes, places and signatures let link, and the share of the permitted distance that their
    signatures take: of all rows if within, else of a row in left with one that is not."""
    length = np.array([len(m) for m in marks])
    found = []
    for size in np.unique(length):
        own = np.flatnonzero(length == size)
        a = np.stack([np.frombuffer(marks[i], np.uint64) for i in own])
        for other in (size, 2 * size):  # sets more than twice as large cannot link
            rows = own if other == size else np.flatnonzero(length == other)
            if not len(rows):
                continue
            b = a if other == size else np.stack([np.frombuffer(marks[i], np.uint64) for i in rows])
            if other != size:
                b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
            step = max(1, (1 << 20) // len(rows))
            for at in range(0, len(own), step):
                x, y = own[at : at + step, None], rows[None, :]
                fit = _reach(n[x], place[x], n[y], place[y], percent) & (label[x] != label[y])
                if other == size:
                    fit &= x < y
                if not within:
                    fit &= left[x] != left[y]
                i, j = np.nonzero(fit)
                i += at
                apart = _apart(a, b, i, j)
                sizes = n[own[i]] + n[rows[j]]
                most = sizes - 2 * least_overlap(n[own[i]], n[rows[j]], percent)
                near = apart <= most
                found.append((own[i[near]], rows[j[near]], apart[near] / np.maximum(1, most[near])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def spanning_forest(m: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Edges of a forest of the lightest edges that spans what the edges (a, b) of m nodes connect."""
    order = np.lexsort((b, a, weight))
    root, taken = np.arange(m), []
    while len(order):
        x, y = root[a[order]], root[b[order]]
        lightest = np.full(m, len(order))
        np.minimum.at(lightest, x, np.arange(len(order)))
        np.minimum.at(lightest, y, np.arange(len(order)))
        pick = np.unique(lightest[lightest < len(order)])
        taken.append(order[pick])
        u, v, to = x[pick], y[pick], np.arange(m)
        while True:
            low = np.minimum(to[u], to[v])
            new = to.copy()
            np.minimum.at(new, to[u], low)
            np.minimum.at(new, to[v], low)
            new = new[new]
            if (new == to).all():
                break
            to = new
        root = to[root]
        order = order[root[a[order]] != root[b[order]]]
    return np.concatenate(taken) if taken else np.zeros(0, np.int64)


def _blocks(columns: DataFrame, marks: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Distinct pairs (pn, ph) and (n, h) of nodes with different labels (cn, ch) in one of the columns that may link: a spanning
    forest from each block of a column, or all."""
    counts = columns.groupBy("token").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("sides"))
    own = F.pmod(F.xxhash64("h", "n"), F.col("sides")).cast("int")
    rows = columns.join(counts, "token").withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    # a row meets every side of its column: once its own, and each other one
    dealt = rows.join(marks, ["n", "h"]).select("token", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "place", "n", "h", F.xxhash64("cn", "ch").alias("label"), "signature")

    @frugal
    def run(batches):
        key, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    if held:
                        yield from block(key, held)
                    key, held = row[:3], []
                held.append(row[3:])
        if held:
            yield from block(key, held)

    def block(key, held):
        side, place, n, h, label, marks = zip(*held, strict=True)
        n, place, label, h = (np.array(x, np.int64) for x in (n, place, label, h))
        i, j, share = near_pairs(n, place, label, list(marks), np.array(side) == key[1], percent, key[1] == key[2])
        if forest:
            _, known = np.unique(label, return_inverse=True)
            kept = spanning_forest(len(n), known[i], known[j], share)
            i, j = i[kept], j[kept]
        if len(i):
            turned = (n[i] > n[j]) | (n[i] == n[j]) & (h[i] > h[j])
            i, j = np.where(turned, j, i), np.where(turned, i, j)
            yield pa.RecordBatch.from_arrays([pa.array(n[i].astype(np.int32)), pa.array(h[i]), pa.array(n[j].astype(np.int32)), pa.array(h[j])], ["pn", "ph", "n", "h"])

    keyed = dealt.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
    return keyed.mapInArrow(run, "pn int, ph long, n int, h long").distinct()


def _spread(tables: Scratch, edges: DataFrame) -> DataFrame:
    """``u, c``: the smallest node that each node of the edges (u, v) reaches. Labels flow over edges and are then taken from the
    label's own node, until none changes."""
    both = tables.cut(edges.union(edges.select("v", "u")).distinct(), "edges")
    labels = tables.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("c")), "spread")
    while True:
        seen = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("c").alias("m"))
        spread = labels.join(seen, "u").select("u", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        hop = spread.select(F.col("u").alias("c"), F.col("c").alias("next"))
        moved = tables.cut(spread.join(hop, "c", "left").select("u", F.least("c", F.coalesce("next", "c")).alias("c"), "old"), "spread")
        if moved.where("c <> old").isEmpty():
            return moved.select("u", "c")
        labels = moved.drop("old")


def components(tables: Scratch, links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``n, h, cn, ch``: the smallest node that each linked node reaches, of links (pn, ph, n, h) and what labels say already; only
    links between different labels count then."""
    edges = links.select(F.struct("pn", "ph").alias("u"), F.struct(F.col("n").alias("pn"), F.col("h").alias("ph")).alias("v"))
    if labels is None:
        found = _spread(tables, edges)
    else:
        known = labels.select(F.struct(F.col("n").alias("pn"), F.col("h").alias("ph")).alias("u"), F.struct(F.col("cn").alias("pn"), F.col("ch").alias("ph")).alias("c"))
        ends = edges.join(known, "u", "left").select(F.coalesce("c", "u").alias("a"), "v").join(known.withColumnRenamed("u", "v"), "v", "left").select("a", F.coalesce("c", "v").alias("b"))
        merged = _spread(tables, ends.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
        new = known.join(merged.select(F.col("u").alias("c"), F.col("c").alias("next")), "c", "left").select("u", F.coalesce("next", "c").alias("c"))
        # labels that were nobody's, and nodes that had no link before
        found = new.union(merged.join(known, "u", "left_anti"))
    return tables.cut(found.select(F.col("u.pn").alias("n"), F.col("u.ph").alias("h"), F.col("c.pn").alias("cn"), F.col("c.ph").alias("ch")), "labels")


def _open(columns: DataFrame, labels: DataFrame) -> DataFrame:
    """columns with the labels (cn, ch) of their nodes, where a column has several; nodes without links are their own."""
    rows = columns.select("token", "place", "n", "h").join(labels, ["n", "h"], "left").withColumns({"cn": F.coalesce("cn", "n"), "ch": F.coalesce("ch", "h")})
    open_ = rows.groupBy("token").agg(F.min(F.struct("cn", "ch")).alias("a"), F.max(F.struct("cn", "ch")).alias("b")).where("a <> b").select("token")
    return rows.join(open_, "token")


def _solve(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text_hash, text): its rows' doc_id, text_hash, n, h, and each node's component: its smallest doc_id,
    and the row that comes first in it."""
    spark = docs.sparkSession
    tables = Scratch(spark)
    profile = tables.cut(_profile(docs, n), "profile")
    rows = profile.where("kind = 0").select("doc_id", "text_hash", "n", "h")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    nodes = tables.cut(rows.where("n > 0").groupBy("n", "h").agg(F.min("doc_id").alias("doc_id"), first), "nodes")
    counts = spark.sparkContext.broadcast(_occurrences(profile))
    product = tables.cut(_multiply(_prefixes(docs, n, percent, counts), percent), "product")
    counts.destroy()
    pairs = tables.cut(product.where("kind = 0").select("pn", "ph", "n", "h").distinct(), "pairs")
    columns = tables.cut(product.where("kind = 1").select("token", "place", "n", "h").distinct(), "columns")
    tables.drop("product")
    needed = pairs.select("n", "h").union(pairs.select("pn", "ph")).union(columns.select("n", "h")).distinct()
    loaded = _load(tables, docs, tables.cut(needed.join(nodes.select("n", "h", "doc_id"), ["n", "h"]), "needed"), n)
    marks = loaded.select("n", "h", "signature")
    alone = columns.withColumns({"cn": F.col("n"), "ch": F.col("h")})
    nearest = tables.cut(_blocks(alone, marks, percent, forest=True).unionByName(pairs).distinct(), "nearest")
    labels = components(tables, tables.cut(_links(loaded, nearest, percent), "links"))
    open_ = tables.cut(_open(columns, labels), "open")
    if not open_.isEmpty():
        rest = tables.cut(_blocks(open_, marks, percent, forest=False).join(nearest, ["pn", "ph", "n", "h"], "left_anti"), "rest")
        labels = components(tables, tables.cut(_links(loaded, rest, percent), "links"), labels)
    named = nodes.join(labels, ["n", "h"], "left").select("n", "h", F.coalesce("cn", "n").alias("cn"), F.coalesce("ch", "h").alias("ch"), "doc_id", "first")
    smallest = named.groupBy("cn", "ch").agg(F.min("doc_id").alias("component_id"), F.min("first").alias("first"))
    members = tables.cut(named.select("n", "h", "cn", "ch").join(smallest, ["cn", "ch"]).select("n", "h", "component_id", "first"), "members")
    tables.keep("profile", "members")
    return rows, members


def _inputs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def join(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id``. Sets of n-word shingles link when 100 * intersection >= percent * union;
    component_id is the smallest doc_id that links reach, its own included."""
    rows, members = _solve(_inputs(docs, doc_id, text), n, percent)
    # empty sets match nothing; their keys are spread by id
    keyed = rows.withColumn("h", F.when(F.col("n") > 0, F.col("h")).otherwise(F.xxhash64("doc_id")))
    found = keyed.join(members.select("n", "h", "component_id"), ["n", "h"], "left")
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with one row of each component: that of the smallest id (null ids after all others), any of equal
    rows. Rows with empty sets all stay."""
    _, members = _solve(_inputs(docs, doc_id, text), n, percent)
    winners = members.select(F.col("first.doc_id").alias("won"), F.col("first.text_hash").alias("text_hash")).distinct()
    keyed = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(text).rlike(SPACE_WORD), F.lit(False)).alias("words"), F.struct("*").alias("row"))
    some = keyed.where("words")
    same = (some["text_hash"] == winners["text_hash"]) & some["id"].eqNullSafe(winners["won"])
    first = some.join(winners, same, "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("text_hash", "id").orderBy("id")))
    return first.where("place = 1").select("row.*").unionByName(keyed.where("not words").select("row.*"))
