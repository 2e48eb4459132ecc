"""Language-model scores of whole texts by online logistic context mixing.

A text is its folded words and an end. A word is spelled by its bytes and a space, each byte by binary decisions along a Huffman tree
of the bytes that follow the byte before it. Each decision is predicted from hashed contexts within the word: the last one, two, three
and five bytes, and the whole of the word so far. A context's slot holds how often either bit came in the learned texts. The
predictions meet in the logistic domain under weights of a set that is chosen (gated) by the place in the word and by whether the
whole context was ever seen; a map from the mixed prediction to a correction refines it. Weights and map start alike for each text and
are adapted while it is scored, after each STEP words, so a text's score hangs on the model and on the text alone.

How the work is dealt: rows are packed into blocks of texts, a block's words stand once in its vocabulary. The vocabularies are counted
over all blocks, and the counts return to the blocks by a join, so that a frequent word is one row a block. The slots learn from
the counted vocabulary. Slots number up to 2^MOST_BITS for each context, 7 MB in all, which bounds the table that is broadcast; the word counts are exact.

Null and empty texts have only the end. Null ids are not held out and teach nothing. Repeated rows get repeated results, an empty
table an empty one; where nothing is learned all counts are 0 and every decision starts at one half. Other columns may have any names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_FOLD, Places, bounded_batches, cut, frugal, give_back, slices, utf8, words_of

#: The word that ends a text, and the byte that ends a word; neither stands in a word.
END, STOP = b"\n", 0x20
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Bytes before a decision that each context holds; the last context is the whole word so far.
ORDERS = (1, 2, 3, 5)
CONTEXTS = len(ORDERS) + 1
#: Slots of each context: SLOTS_A_WORD for each learned word, as a power of two within these bounds.
SLOTS_A_WORD, LEAST_BITS, MOST_BITS = 32, 14, (16, 18, 20, 21, 22)
#: Slots that are added up together.
CHUNK = 1 << 14
#: Distinct words that one task learns from, and words whose decisions it lays out at once.
SHARE, LAID_OUT = 2_000_000, 16_384
#: Added to both counts of a slot; stretched predictions are held in 16ths of a unit.
PRIOR, UNIT = 0.4, 16.0
#: Words after which the weights of a text are adapted, and the rates of weights and map.
STEP, RATE, MAP_RATE = 32, 0.002, 0.004
#: Gates: four places in a word, whole context seen or not. First weights of the contexts: not seen, seen.
GATES = 8
FIRST = ((0.15, 0.25, 0.4, 0.35, 0.0), (0.0, 0.0, 0.1, 0.2, 0.7))
#: Cells of the refining map, one for each unit of the mixed prediction.
CELLS = 16
#: Texts that are scored side by side.
SIDE = 128


# Binary code of bytes


@dataclass(frozen=True)
class Code:
    """For each byte and the byte before it: where its decisions begin, their number; and of each decision the node and the bit."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def huffman(counts: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """Nodes and bits from the root to each symbol. Counts are scaled such that no path is long; ties go by the order of making."""
    known = counts.tolist()
    total = max(1, sum(known))
    heap = [((n << 20) // total + 1, i, i) for i, n in enumerate(known)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    made = len(counts)
    while len(heap) > 1:
        (n, _, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], parent[b] = (made, 0), (made, 1)
        heapq.heappush(heap, (n + m, made, made))
        made += 1
    out = []
    for symbol in range(len(counts)):
        nodes, bits, at = [], [], symbol
        while at in parent:
            at, bit = parent[at]
            nodes.append(at - len(counts))
            bits.append(bit)
        out.append((nodes[::-1], bits[::-1]))
    return out


def make_code(follows: np.ndarray) -> Code:
    """The code of counts (byte before, byte)."""
    paths = [p for row in follows for p in huffman(row)]
    length = np.array([len(n) for n, _ in paths], np.int32)
    start = np.r_[0, np.cumsum(length)[:-1]].astype(np.int64)
    node = np.array([x for n, _ in paths for x in n], np.uint8)
    return Code(start, length, node, np.array([x for _, b in paths for x in b], np.uint8))


# Decisions of words


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, each with its stop, and how many each word has."""
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    return np.frombuffer(b" ".join(words) + b" " if words else b"", np.uint8), sizes


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    total = int(length.sum())
    shift = np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length)
    return shift + np.arange(total)


def before(data: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The byte k places earlier in the same word, the stop where there is none."""
    out = np.full(len(data), STOP, np.uint8)
    if len(data) > k:
        out[k:] = data[:-k]
    out[place < k] = STOP
    return out


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Decisions:
    """The decisions of words: slots (contexts, decisions), bits, gate without the seen flag, and decisions of each word."""

    slots: np.ndarray
    bits: np.ndarray
    place: np.ndarray
    sizes: np.ndarray


def decisions(words: list[bytes], code: Code, bits: tuple[int, ...]) -> Decisions:
    data, sizes = spelled(words)
    begin = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
    place = np.arange(len(data)) - np.repeat(begin, sizes)
    last = before(data, place, 1)
    pair = last.astype(np.int64) * 256 + data
    length = code.length[pair].astype(np.int64)
    at = ranges(code.start[pair], length)
    # The byte before and the node name the decision; contexts differ in what else they hold.
    decision = np.repeat(last.astype(np.uint64) << np.uint64(8), length) | code.node[at].astype(np.uint64)
    slots = np.empty((CONTEXTS, len(at)), np.uint32)
    with np.errstate(over="ignore"):
        history = np.zeros(len(data), np.uint64)
        contexts, reach = [], 0
        for order in ORDERS:
            while reach < order:
                history |= before(data, place, reach + 1).astype(np.uint64) << np.uint64(8 * reach)
                reach += 1
            contexts.append(history.copy())
        # The word so far: a polynomial of its bytes by their places, as a difference of running sums.
        powers = np.cumprod(np.full(int(place.max(initial=0)) + 2, MULTIPLIER, np.uint64))
        term = (data.astype(np.uint64) + np.uint64(1)) * powers[place]
        run = np.r_[np.uint64(0), np.cumsum(term)]
        contexts.append(run[:-1] - np.repeat(run[begin], sizes))
        for i, context in enumerate(contexts):
            mixed = (context + np.uint64(i + 1)) * MULTIPLIER
            mixed ^= mixed >> np.uint64(29)
            key = (np.repeat(mixed, length) + decision) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(32)
            slots[i] = (key * MULTIPLIER) >> np.uint64(64 - bits[i])
    gate = np.repeat(np.minimum(place, 3).astype(np.uint8), length)
    ends = np.r_[0, np.cumsum(length)]
    return Decisions(slots, code.bit[at], gate, ends[begin + sizes] - ends[begin])


# Blocks and counts


def blocks(docs: DataFrame, held: Column, text: str, key: str) -> DataFrame:
    """One row for each block of texts: doc_id, held_out, n_bytes, n_tokens (arrays), and compressed: places of the words in the block's vocabulary
    (32-bit, one text after the other), the vocabulary by falling frequency, and how often each of its words stands in the learned texts."""

    @frugal
    def run(batches):
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        made, pack = 0, Pack()
        for whole in batches:
            for batch in slices(whole):
                for doc, learned, out, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), utf8(batch.column(3)), strict=True):
                    pack.add(doc, learned, out, t)
                    if pack.bytes >= BLOCK_BYTES:
                        yield pack.row((task << 32) + made)
                        made, pack = made + 1, Pack()
        if pack.docs:
            yield pack.row((task << 32) + made)

    schema = "block long, docs array<long>, held array<boolean>, n_bytes array<long>, n_tokens array<long>, places binary, words binary, learned binary"
    out = F.coalesce(held, F.lit(False))
    # the text goes last under a name of its own, whatever the columns before it are
    rows = docs.select(F.col(key).alias("a"), (F.col(key).isNotNull() & ~out).alias("b"), out.alias("c"), F.col(text).alias("d"))
    return rows.mapInArrow(run, schema)


class Pack:
    def __init__(self):
        self.docs, self.held, self.n_bytes, self.n_tokens, self.places, self.ids, self.learned, self.bytes = [], [], [], [], [], Places(), [], 0

    def add(self, doc, learned, held, text):
        tokens = [*words_of(text, SPACE_FOLD), END]
        places = np.fromiter(map(self.ids.__getitem__, tokens), np.uint32, len(tokens))
        if learned:
            self.learned.append(places)
        self.docs.append(doc)
        self.held.append(held)
        self.n_bytes.append(len(text or b""))
        self.n_tokens.append(len(tokens))
        self.places.append(places)
        self.bytes += len(text or b"") + 64

    def row(self, block: int) -> pa.RecordBatch:
        places = np.concatenate(self.places)
        order = np.argsort(-np.bincount(places, minlength=len(self.ids)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        learned = np.bincount(rank[np.concatenate(self.learned)], minlength=len(order)) if self.learned else np.zeros(len(order), np.int64)
        words = [*self.ids]
        packed = [rank[places].tobytes(), b" ".join([words[i] for i in order.tolist()]), learned.astype(np.int64).tobytes()]
        lists = [pa.array([x], pa.list_(t)) for x, t in ((self.docs, pa.int64()), (self.held, pa.bool_()), (self.n_bytes, pa.int64()), (self.n_tokens, pa.int64()))]
        names = ["block", "docs", "held", "n_bytes", "n_tokens", "places", "words", "learned"]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *lists, *[pa.array([zstandard.compress(x, 3)], pa.binary()) for x in packed]], names)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def vocabulary(packed: DataFrame, rows: int = 65_536) -> DataFrame:
    """block, place, word and n (how often the block's learned texts hold it) of all blocks' words."""

    @frugal
    def run(batches):
        for batch in batches:
            for block, words, learned in zip(*[batch.column(c).to_pylist() for c in ("block", "words", "learned")], strict=True):
                words, learned = zstandard.decompress(words).split(b" "), unpacked(learned, np.int64)
                for first in range(0, len(words), rows):
                    part = words[first : first + rows]
                    columns = [pa.array(np.full(len(part), block)), pa.array(np.arange(first, first + len(part), dtype=np.int32)), pa.array(part, pa.binary()), pa.array(learned[first : first + rows])]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "place", "word", "n"])

    return packed.select("block", "words", "learned").mapInArrow(run, "block long, place int, word binary, n long")


# Learning


@dataclass(frozen=True)
class Model:
    code: Code
    #: Logarithms of the numbers of slots, and their stretched predictions, by context.
    bits: tuple[int, ...]
    slots: list[np.ndarray]
    tokens: int
    distinct: int


def _packed(batches: Iterator[pa.RecordBatch], size: int = LAID_OUT) -> Iterator[tuple[list[bytes], np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            yield part.column(0).to_pylist(), part.column(1).to_numpy().astype(np.float64)


def _follows(counts: DataFrame) -> np.ndarray:
    """How often each byte follows each in learned words: 65,536 numbers at most."""

    @frugal
    def run(batches):
        total = np.zeros(1 << 16)
        for words, n in _packed(batches):
            data, sizes = spelled(words)
            place = ranges(np.zeros(len(sizes), np.int64), sizes)
            total += np.bincount(before(data, place, 1).astype(np.int64) * 256 + data, weights=np.repeat(n, sizes), minlength=1 << 16)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found].astype(np.int64))], ["pair", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in counts.select("word", "n").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(256, 256)


def learn(counts: DataFrame, most_bits: tuple[int, ...] = MOST_BITS) -> Model:
    """The model of counted words (word, n). Each task adds up all slots for its share of the words and hands them on in chunks without
    empty ones; the sums become predictions of a byte each, so many of which at most as most_bits allow reach the driver."""
    spark = counts.sparkSession
    known = counts.where("n > 0").select("word", "n")
    size = known.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    code = make_code(_follows(known))
    wanted = math.ceil(math.log2(SLOTS_A_WORD * size["v"] + 1))
    bits = tuple(max(LEAST_BITS, min(wanted, most)) for most in most_bits)
    shared = spark.sparkContext.broadcast(code)

    @frugal
    def add_up(batches):
        code = shared.value
        sums = [np.zeros(2 << b) for b in bits]
        for words, n in _packed(batches):
            d = decisions(words, code, bits)
            weight = np.repeat(n, d.sizes)
            for i in range(CONTEXTS):
                np.add.at(sums[i], d.slots[i].astype(np.int64) * 2 + d.bits, weight)
        for i in range(CONTEXTS):
            for chunk in range((1 << bits[i]) // CHUNK):
                part = sums[i][2 * CHUNK * chunk : 2 * CHUNK * (chunk + 1)]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([chunk], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["context", "chunk", "sums"])

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros(2 * CHUNK)
        for x in group.column("sums"):
            total += np.frombuffer(x.as_buffer(), np.float64)
        said = stretched(total.reshape(-1, 2))
        return pa.table({"context": group.column("context")[:1], "chunk": group.column("chunk")[:1], "said": pa.array([said.tobytes()], pa.binary())})

    shares = max(1, math.ceil(size["v"] / SHARE))
    dealt = known.repartition(shares, "word").mapInArrow(add_up, "context int, chunk int, sums binary")
    merged = dealt.groupBy("context", "chunk").applyInArrow(merge, "context int, chunk int, said binary")
    slots = [np.zeros(1 << b, np.int8) for b in bits]
    for r in merged.toLocalIterator():
        slots[r["context"]][r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["said"], np.int8)
    shared.destroy()
    return Model(code, bits, slots, size["n"], size["v"])


def stretched(counts: np.ndarray) -> np.ndarray:
    """Logits of the counts of both bits, in 16ths; 0 where nothing was seen."""
    logit = np.log((counts[:, 1] + PRIOR) / (counts[:, 0] + PRIOR))
    return np.clip(np.rint(logit * UNIT), -127, 127).astype(np.int8)


# Scoring


def spell_out(words: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the decisions of words: predictions signed by the bit that came (contexts, decisions), sign, gate; and decisions a word."""
    said, sign, gate, sizes = [], [], [], []
    for start in range(0, len(words), LAID_OUT):
        d = decisions(words[start : start + LAID_OUT], model.code, model.bits)
        s = np.stack([model.slots[i][d.slots[i]] for i in range(CONTEXTS)])
        way = (2 * d.bits.astype(np.int8) - 1).astype(np.int8)
        gate.append((d.place + 4 * (s[-1] != 0)).astype(np.uint8))
        said.append(s * way)
        sign.append(way)
        sizes.append(d.sizes)
    return np.concatenate(said, axis=1), np.concatenate(sign), np.concatenate(gate), np.concatenate(sizes)


def mixed(texts: list[np.ndarray], spelling: tuple) -> np.ndarray:
    """log10 probability of each text (places of its words in the spelling). Side by side, STEP words of each text at a time."""
    said, sign, gate, sizes = spelling
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    total = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    for first in range(0, len(order), SIDE):
        mine = order[first : first + SIDE]
        weights = np.tile(np.array([FIRST[g // 4] for g in range(GATES)], np.float32), (len(mine), 1)).T.copy()
        cells = np.zeros(len(mine) * CELLS, np.float32)
        active = len(mine)
        for step in range(0, len(texts[mine[0]]), STEP):
            while active and len(texts[mine[active - 1]]) <= step:
                active -= 1
            parts = [texts[i][step : step + STEP] for i in mine[:active]]
            places = np.concatenate(parts)
            length = sizes[places]
            at = ranges(begin[places], length)
            # which text each decision is of
            words = np.array([len(p) for p in parts])
            per_text = np.add.reduceat(length, np.r_[0, np.cumsum(words)[:-1]])
            owner = np.repeat(np.arange(active), per_text)
            key = owner * GATES + gate[at]
            x = [said[i][at] * np.float32(1 / UNIT) for i in range(CONTEXTS)]
            z = sum(weights[i][key] * x[i] for i in range(CONTEXTS))
            way = sign[at]
            cell = owner * CELLS + np.clip(z * way + CELLS // 2, 0, CELLS - 1).astype(np.int64)
            z = np.clip(z + cells[cell] * way, -20, 20)
            miss = np.exp(-z)
            loss = np.log(1 + miss)
            miss /= 1 + miss
            ends = np.r_[0, np.cumsum(per_text)[:-1]]
            total[mine[:active]] -= np.add.reduceat(loss, ends, dtype=np.float64)
            for i in range(CONTEXTS):
                weights[i] += np.float32(RATE) * np.bincount(key, weights=miss * x[i], minlength=weights.shape[1]).astype(np.float32)
            cells += np.float32(MAP_RATE) * np.bincount(cell, weights=miss * way, minlength=len(cells)).astype(np.float32)
    return total / math.log(10)


def score(docs: DataFrame, held: Column, text: str = "text", key: str = "doc_id", most_bits: tuple[int, ...] = MOST_BITS) -> DataFrame:
    """One row for each document: doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score (additive smoothing of single words), score
    (log10 probability by the mixing model) and bits_per_byte. Learns from the documents with an id where held does not hold."""
    spark = docs.sparkSession
    bounded_batches(spark)
    packed = cut(blocks(docs, held, text, key), "lm-blocks")
    words = vocabulary(packed)
    counts = cut(words.where("n > 0").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    model = learn(counts, most_bits)
    shared = spark.sparkContext.broadcast(model)
    known = words.select("block", "place", "word").join(counts, "word").select(F.col("block").alias("of"), "place", "n")
    fields = "doc_id long, held_out boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return pa.concat_tables([scored(row, right, shared.value) for row in left.to_pylist()]) if left.num_rows else scored_schema()
        finally:
            give_back()

    def scored(row: dict, found: pa.Table, model: Model) -> pa.Table:
        words = zstandard.decompress(row["words"]).split(b" ")
        count = np.zeros(len(words))
        count[found.column("place").to_numpy()] = found.column("n").to_numpy()
        places = unpacked(row["places"], np.uint32).astype(np.int64)
        ends = np.cumsum(row["n_tokens"])
        texts = np.split(places, ends[:-1])
        loss = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
        starts = np.r_[0, ends[:-1]]
        base = np.add.reduceat(loss[places], starts)
        seen = np.add.reduceat((count > 0)[places].astype(np.int64), starts)
        value = mixed(texts, spell_out(words, model))
        size = np.maximum(np.array(row["n_bytes"]), 1)
        columns = [row["docs"], row["held"], row["n_bytes"], row["n_tokens"], seen, np.full(len(seen), model.tokens), base, value, -value * math.log2(10) / size]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, scored_schema().schema, strict=True)], schema=scored_schema().schema)

    def scored_schema() -> pa.Table:
        kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 4, *[pa.float64()] * 3]
        return pa.schema([(f.split()[0], k) for f, k in zip(fields.split(", "), kinds, strict=True)]).empty_table()

    return packed.drop("learned").groupBy("block").cogroup(known.groupBy("of")).applyInArrow(run, fields)
