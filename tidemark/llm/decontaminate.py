"""Benchmark decontamination: documents that hold windows of benchmark items.

A window is WINDOW consecutive words of an item; an item of fewer words is one window. A document holds a window where the
same words stand consecutively, so a window's containment threshold is one and its necessary prefix a single shingle: the
rarest of its shingles over all documents. Documents' shingles meet these prefixes in a hash join by block; the shingle's
place in the window and the document's length bound where the window can stand, and the words are compared there.

The benchmark is joined in blocks of at most BLOCK_WORDS words (an item is never split), each broadcast in turn; a benchmark of one block, the usual
case, takes one pass for the shingles' counts and one for the join. Null texts and texts without words have no hits, such
items no windows; items with a null id are ignored. Repeated rows get repeated results; a repeated item counts once. Empty
tables give empty results, or documents without hits. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM_FOLD, bounded_batches, cut, frugal, slices, utf8, words_of

WINDOW = 10
#: Words of a shingle; windows of fewer words are a shingle themselves.
SHINGLE = 4
#: Words of items that are broadcast at once.
BLOCK_WORDS = 500_000
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
STATE = "doc_id long, text string, hits binary, items array<string>"

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _codes(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code for the words at each place and the size - 1 after it."""
    n = len(ids) - size + 1
    h = np.zeros(max(0, n), np.uint64)
    for k in range(size):
        h = (h ^ (ids[k : k + n].astype(np.uint64) + np.uint64(k + 1))) * _MIX
        h ^= h >> np.uint64(29)
    return h


class Windows:
    """Distinct windows of a block of items, their words as ids of the block's vocabulary."""

    def __init__(self, items: Iterable[tuple[str, bytes | None]], window: int, shingle: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text, ALNUM_FOLD)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                found.setdefault(tuple(ids[i : i + size]), set()).add(item)
        #: By window length: words as a matrix, items of each row.
        self.words: dict[int, np.ndarray] = {}
        self.items: dict[int, list[list[str]]] = {}
        for size in sorted({len(w) for w in found}):
            own = sorted(w for w in found if len(w) == size)
            self.words[size] = np.array(own, np.int64)
            self.items[size] = [sorted(found[w]) for w in own]
        self.shingle = shingle
        #: Sorted codes of all shingles by shingle size; filled by order().
        self.shingles = {s: np.unique(np.concatenate([_codes_of_rows(m, s).ravel() for size, m in self.words.items() if min(shingle, size) == s])) for s in {min(shingle, size) for size in self.words}}
        self.prefixes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Choose each window's rarest shingle by the counts over all documents (parallel to shingles); by code on ties."""
        for size, matrix in self.words.items():
            s = min(self.shingle, size)
            codes = _codes_of_rows(matrix, s)
            seen = counts[s][np.searchsorted(self.shingles[s], codes)]
            rarest = np.lexsort((codes, seen), axis=1)[:, 0]
            prefix = codes[np.arange(len(codes)), rarest]
            by = np.argsort(prefix, kind="stable")
            self.prefixes[size, s] = (prefix[by], by, rarest[by])


def _codes_of_rows(matrix: np.ndarray, size: int) -> np.ndarray:
    return np.stack([_codes(row, size) for row in matrix]) if len(matrix) else np.zeros((0, 1), np.uint64)


def _ids(texts: list[bytes | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all texts, -1 for words of no item and after each text; where each text begins, and the end."""
    ids: list[int] = []
    begins = [0]
    for text in texts:
        ids += [vocabulary.get(w, -1) for w in words_of(text, ALNUM_FOLD)]
        ids.append(-1)
        begins.append(len(ids))
    return np.array(ids, np.int64), np.array(begins, np.int64)


def _valid(ids: np.ndarray, size: int) -> np.ndarray:
    """Places of which size words are known."""
    bad = np.concatenate([[0], np.cumsum(ids < 0)])
    return bad[size:] == bad[:-size] if len(ids) >= size else np.zeros(0, bool)


def occurrences(windows: Windows, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of windows.words[length], places where they stand)."""
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for (size, s), (prefix, rows, offset) in windows.prefixes.items():
        if s not in known:
            at = np.flatnonzero(_valid(ids, s))
            known[s] = (at, _codes(ids, s)[at])
        at, codes = known[s]
        low, high = np.searchsorted(prefix, codes, "left"), np.searchsorted(prefix, codes, "right")
        some = np.flatnonzero(high > low)
        for part in np.array_split(some, 1 + int((high - low)[some].sum()) // 1_000_000):
            many = (high - low)[part]
            entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[part], many)
            start = np.repeat(at[part], many) - offset[entry]
            fits = (start >= 0) & (start + size <= len(ids))
            start, row = start[fits], rows[entry[fits]]
            same = np.ones(len(start), bool)
            for k in range(size):
                same &= ids[start + k] == windows.words[size][row, k]
            yield size, row[same], start[same]


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, carry: bool = False) -> DataFrame:
    """Per row of docs: columns of SCHEMA, and with carry the row itself as a struct named row. n_hit counts words inside any occurrence of a window, items lists the items with
    occurring windows, sorted as strings; items_sha256 is of these, comma-joined."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null").distinct()
    total = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0.0
    blocks = 1 + int(total // (2 * BLOCK_WORDS))
    bounded_batches(spark)
    state = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *([F.struct("*").alias("row")] if carry else []))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        windows = Windows(((r["item"], r["text"].encode()) for r in rows), window, shingle)
        windows.order(_document_counts(state, windows))
        shared = spark.sparkContext.broadcast(windows)
        state = _join_block(state, shared, block == 0, block == blocks - 1)
        if block < blocks - 1:
            state = cut(state, "decontaminate")
            shared.destroy()
    return state


def _document_counts(docs: DataFrame, windows: Windows) -> dict[int, np.ndarray]:
    """How often each shingle of the windows stands in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((windows.vocabulary, windows.shingles))

    @frugal
    def run(batches):
        vocabulary, shingles = shared.value
        counts = {s: np.zeros(len(c), np.int64) for s, c in shingles.items()}
        for whole in batches:
            for batch in slices(whole):
                ids, _ = _ids(utf8(batch.column(0)), vocabulary)
                for s, codes in shingles.items():
                    seen = _codes(ids, s)[_valid(ids, s)]
                    at = np.searchsorted(codes, seen)
                    at[at == len(codes)] = 0
                    counts[s] += np.bincount(at[codes[at] == seen], minlength=len(codes))
        for s, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, np.int32)), pa.array(at), pa.array(own[at])], ["size", "at", "n"])

    counts = {s: np.zeros(len(c), np.int64) for s, c in windows.shingles.items()}
    summed = docs.select("text").mapInArrow(run, "size int, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n"))
    for r in summed.toLocalIterator():  # no more rows than the block has shingles
        counts[r["size"]][r["at"]] = r["n"]
    shared.destroy()
    return counts


def _join_block(state: DataFrame, shared, first: bool, last: bool) -> DataFrame:
    carried = ["row"] if "row" in state.columns else []

    @frugal
    def run(batches):
        windows = shared.value
        for whole in batches:
            for batch in slices(whole):
                texts = utf8(batch.column(1))
                row = [batch.column(batch.num_columns - 1)] if carried else []
                ids, begins = _ids(texts, windows.vocabulary)
                edge = np.zeros(len(ids) + 1, np.int64)
                items: list[set[str]] = [set(x or ()) for x in batch.column(3).to_pylist()] if not first else [set() for _ in texts]
                for size, rows, starts in occurrences(windows, ids):
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + size, -1)
                    doc = np.searchsorted(begins, starts, "right") - 1
                    for d, r in np.unique(np.stack([doc, rows], 1), axis=0).tolist():
                        items[d].update(windows.items[size][r])
                hit = np.cumsum(edge[:-1]) > 0
                if not first:
                    for i, bits in enumerate(batch.column(2).to_pylist()):
                        if bits:
                            n = begins[i + 1] - begins[i] - 1
                            hit[begins[i] : begins[i] + n] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
                if last:
                    n_hit = np.add.reduceat(hit, begins[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
                    ordered = [sorted(x) for x in items]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0), pa.array(np.diff(begins) - 1), pa.array(n_hit), pa.array([len(x) for x in ordered], pa.int64()),
                            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in ordered], pa.string()), pa.array(n_hit > 0), pa.array(ordered, pa.list_(pa.string())), *row,
                        ],
                        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", *carried],
                    )
                else:
                    bits = [np.packbits(hit[a : b - 1]).tobytes() for a, b in zip(begins, begins[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), *row], ["doc_id", "text", "hits", "items", *carried])

    more = f", row {state.schema['row'].dataType.simpleString()}" if carried else ""
    return state.mapInArrow(run, (SCHEMA if last else STATE) + more)
