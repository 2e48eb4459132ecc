"""Importance resampling of documents towards a target collection.

Features are all runs of 1 to LONGEST consecutive words, hashed into buckets by the CRC of their bytes. Each task keeps the runs of
its rows in word tries, whose nodes hold how often a run came and the CRC state after it, so that a longer run continues its
prefix's state and each distinct run is hashed once. Bucket totals of all tasks are merged; a bucket's gain is the logarithm of its
smoothed share in the target against that in the documents. Documents are then scored along the paths of tries whose nodes have
their bucket's gain, and the highest perturbed scores (Gumbel noise by id) are drawn without replacement.

Null and empty texts have no words, no features and weight 0. A null id draws its noise from an empty text and comes last on ties.
Repeated rows get the same score and follow one another. Empty tables, either one, give smoothed shares alone. Other columns may
have any names. A trie takes the texts up to TRIE_WORDS words, or one longer text, which bounds memory and changes no total.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM_FOLD, Places, bounded_batches, cut, frugal, slices, utf8, words_of

BUCKETS = 10_000
LONGEST = 2
#: Words after which a task begins a new trie.
TRIE_WORDS = 400_000
#: Percent of the eligible documents that are drawn, and how many words make a document eligible.
PERCENT, LEAST_WORDS = 25, 20
SEED = 7


#: Words of more bytes advance states one by one, not by a table for their length.
TABLE_BYTES = 64


@functools.lru_cache(maxsize=TABLE_BYTES + 2)
def _shift_tables(length: int) -> np.ndarray:
    """What so many bytes make of each byte of a CRC state; CRCs are linear, so a state's bytes may be looked up on their own."""
    zeros = bytes(length)
    bits = np.array([crc32(zeros, 1 << k) ^ crc32(zeros) for k in range(32)], np.uint32)
    values = np.arange(256)
    return np.stack([np.bitwise_xor.reduce([np.where(values >> k & 1, bits[8 * byte + k], 0).astype(np.uint32) for k in range(8)]) for byte in range(4)])


@dataclass
class Level:
    """The nodes of a trie that are so many words deep: the CRC state of each one's run and how often it came; and of all runs of the texts
    (in order of their first words) the node and the text."""

    states: np.ndarray
    counts: np.ndarray
    at: np.ndarray
    text: np.ndarray


class Trie:
    """The runs of a batch of texts as a word trie in arrays, one level after the other: a node is its parent's place and a word."""

    def __init__(self, texts: list[list[bytes]]):
        places = Places()
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ids = np.fromiter(map(places.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        self.words = [*places]
        self.text = np.repeat(np.arange(len(texts)), sizes)
        #: words from each one to the end of its text
        self.left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(self.ids))
        self.tails = np.array([crc32(b" " + w) for w in self.words], np.uint32)
        self.lengths = np.array([len(w) + 1 for w in self.words], np.int64)

    def advance(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The states after one more word each."""
        out = np.empty(len(states), np.uint32)
        lengths = self.lengths[words]
        for length in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == length)
            if length > TABLE_BYTES:
                out[mine] = [crc32(b" " + self.words[w], s) for w, s in zip(words[mine].tolist(), states[mine].tolist(), strict=True)]
                continue
            tables, s = _shift_tables(length), states[mine]
            out[mine] = tables[0][s & 255] ^ tables[1][s >> 8 & 255] ^ tables[2][s >> 16 & 255] ^ tables[3][s >> 24] ^ self.tails[words[mine]]
        return out

    def levels(self, longest: int) -> Iterator[Level]:
        at, starts = self.ids, np.arange(len(self.ids))
        level = Level(np.array([crc32(w) for w in self.words], np.uint32), np.bincount(at, minlength=len(self.words)), at, self.text)
        yield level
        for n in range(2, longest + 1):
            more = self.left[starts] >= n
            starts, parents = starts[more], at[more]
            size = max(1, len(self.words))
            nodes, at, counts = np.unique(parents * size + self.ids[starts + n - 1], return_inverse=True, return_counts=True)
            level = Level(self.advance(level.states[nodes // size], nodes % size), counts, at, self.text[starts])
            yield level


def tries(texts: Iterator[list[bytes]]) -> Iterator[tuple[int, Trie]]:
    """Tries of consecutive texts, each with the number of its texts."""
    held, words = [], 0
    for t in texts:
        held.append(t)
        words += len(t)
        if words >= TRIE_WORDS:
            yield len(held), Trie(held)
            held, words = [], 0
    if held:
        yield len(held), Trie(held)


def bucket_totals(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> list[int]:
    """How many features of all texts fall in each bucket. Comes to the driver: as many numbers as buckets."""

    @frugal
    def run(batches):
        totals = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in slices(whole):
                for _, trie in tries(words_of(t, ALNUM_FOLD) for t in utf8(batch.column(0))):
                    for level in trie.levels(longest):
                        np.add.at(totals, level.states % buckets, level.counts)
        found = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(totals[found], pa.int64())], ["bucket", "n"])

    bounded_batches(texts.sparkSession)
    merged = texts.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in merged.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(documents: list[int], target: list[int]) -> list[int]:
    """1000 times the log ratio of each bucket's smoothed shares, floored."""
    buckets, s_all, t_all = len(documents), sum(documents), sum(target)
    return [math.floor(1000 * math.log(float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets)))) for s, t in zip(documents, target, strict=True)]


def weigh(docs: DataFrame, gain: list[int], text: str = "text", key: str = "doc_id", longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain of a document's features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    @frugal
    def run(batches):
        gain = np.array(shared.value, np.int64)
        for whole in batches:
            for batch in slices(whole):
                first = 0
                for size, trie in tries(words_of(t, ALNUM_FOLD) for t in utf8(batch.column(1))):
                    features, total = np.zeros((2, size), np.int64)
                    for level in trie.levels(longest):
                        features += np.bincount(level.text, minlength=size)
                        np.add.at(total, level.text, gain[level.states % len(gain)][level.at])
                    words = np.bincount(trie.text, minlength=size)
                    columns = [words, features, np.where(features > 0, total // np.maximum(features, 1), 0)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, size), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "n_words", "n_features", "weight"])
                    first += size

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("doc_id"), text).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel deviate by the hash of the id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row for each document: doc_id, n_words, n_features, weight, score, and its rank among those drawn, else null.

    No sort of all documents is needed: scores are whole numbers in a narrow range (gains and noise are thousandths of logarithms, some
    100,000 values at most), so a count of documents a score tells how many stand before it, and ranks go by score.
    """
    gain = gains(bucket_totals(docs, text, buckets, longest), bucket_totals(target, text, buckets, longest))
    scored = cut(weigh(docs, gain, text, key, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample")
    eligible = F.col("n_words") >= least_words
    by_score = scored.where(eligible).groupBy("score").agg(F.count("*").alias("n"))
    downwards = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    # One task, but over scores and not over documents; the table of scores is small enough to broadcast for the same reason.
    places = by_score.select("score", F.coalesce(F.sum("n").over(downwards), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    placed = scored.join(F.broadcast(places.withColumn("drawn", F.floor(F.col("all") * percent / 100).cast("long"))), "score", "left")
    candidate = F.coalesce(eligible & (F.col("before") < F.col("drawn")), F.lit(False))
    rest = placed.where(~candidate).select("doc_id", "n_words", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    ranked = placed.where(candidate).withColumn("place", place.cast("long"))
    first = ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("place") <= F.col("drawn"), F.col("place")).alias("rank"))
    return first.unionByName(rest)
