"""Exact top-k search by BM25: inverted indexes of shards, block-max WAND in each, merged by global statistics.

One pass over the documents cuts them into words and writes, to the shared folder, an inverted index in segments of up to
SEGMENT_BYTES of text (a row each: terms, their documents, how often) and the terms of the queries. A query's terms are the distinct
words of its whole text, each counted once; rows of one id are one query with the terms of all. Document frequencies,
the number of documents and their mean length are of all documents, taken from the index.

Queries come in groups of about GROUP_TERMS terms, each broadcast; a group reads the postings of its terms from the index, and
equal queries in it are searched once. A task joins segments to a shard of up to SHARD_WORDS words, orders its documents so that
like ones stand together, and cuts them into chunks of aligned blocks of BLOCK documents, with the largest impact (whole
contribution to a score) of each term in a chunk and in a block. WAND moves the cursors of a query's terms to the next pivot,
where their maxima exceed the floor, the k-th best score known; with aligned blocks one sum of maxima finds all pivots at once,
those of chunks first, then the blocks in them. Many queries do so together: in a chunk, terms that are asked for often are
columns, so that adding them to the scores of a block's documents for all queries with a pivot there is one product of matrices,
in single precision. Other postings are added first, then columns, and the dense ones only if a block's best score can still
pass the floor. What reaches the floor but for SLACK is scored again in double precision from the document's own terms.
The floor rises with each chunk and from shard to shard of a task, and starts, but for a few pilot segments that are
searched before, from the k-th best score of the pilots. Each shard gives what reaches the floor, k rows at most of k copies of a
document at most, and these are merged.

Scores are rounded to 9 decimals before they are compared, ties go by doc_id, null ids last. Null and empty texts are
neither found nor find anything; neither do documents without a common term. Repeated rows are documents of their own.
Terms are 64-bit hashes of words. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ALNUM_FOLD, Scratch, bounded_batches, frugal, slices, utf8, words_of

K1, B = 1.2, 0.75
#: Text and documents of a segment, words of a shard, documents of a block.
SEGMENT_BYTES, SEGMENT_DOCS, SHARD_WORDS, BLOCK = 4 << 20, 1 << 16, 5_000_000, 64
#: Terms, counted for each query, that are broadcast at once.
GROUP_TERMS = 4_000_000
#: Segments that are searched first, at least, and one of how many.
PILOTS, PILOT_SHARE = 8, 64
#: Frequent terms by which a shard's documents are put together.
MARKERS = 16
#: Documents that are searched at once, and queries that search them at once.
CHUNK, ASKED = 16 * BLOCK, 512
#: Terms of a chunk kept as columns, at most; from which share of its pairs of document and query; the share of documents of dense ones.
COLUMNS, COLUMN, DENSE = 512, 0.001, 0.3
#: Times the floor up to which a chunk's bound is looked into by block.
NEAR = 2.0
#: Part by which scores in single precision may differ, no less than COLUMNS / 2**23.
SLACK = 1e-4
DECIMALS = 9
#: Rows of a result that are handed on at once.
ROWS = 10_000
#: Scores within this are not told apart when blocks are left out: equal ones count, and sums differ in their last bits.
MARGIN = 2 * 10.0**-DECIMALS
NO_ID = np.iinfo(np.int64).max
INDEX = "kind int, query_id long, documents long, words long, terms binary, counts binary, ids binary, lengths binary, docs binary, often binary"
RESULT = "query_id long, doc_id long, score double"


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each range in turn."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


def term(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def segment(ids: list[int | None], texts: list[Counter]) -> dict:
    """An index row of documents given as words and how often they have them."""
    place: dict[bytes, int] = {}
    terms, often = [], []
    for words in texts:
        terms.append(np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words)))
        often.append(np.fromiter(words.values(), np.int64, len(words)))
    docs = np.repeat(np.arange(len(texts)), [len(t) for t in terms])
    hashes = np.fromiter(map(term, place), np.uint64, len(place))
    rank = np.argsort(np.argsort(hashes))
    t, n = rank[np.concatenate(terms)], np.concatenate(often)
    order = np.argsort(t, kind="stable")
    lengths = np.array([sum(words.values()) for words in texts], np.int64)
    parts = {
        "terms": np.sort(hashes),
        "counts": np.bincount(t, minlength=len(place)).astype(np.int32),
        "ids": np.array([NO_ID if i is None else i for i in ids], np.int64),
        "lengths": lengths,
        "docs": docs[order].astype(np.uint16),
        "often": n[order].astype(np.uint32),
    }
    return {"kind": 0, "documents": len(ids), "words": int(lengths.sum())} | {k: v.tobytes() for k, v in parts.items()}


def _index(rows: DataFrame) -> DataFrame:
    """Segments (kind 0) and queries (kind 1) of rows doc_id, text, asked."""
    fields = [("kind", pa.int32()), ("query_id", pa.int64()), ("documents", pa.int64()), ("words", pa.int64())]
    schema = pa.schema([*fields, *((x, pa.binary()) for x in ("terms", "counts", "ids", "lengths", "docs", "often"))])

    @frugal
    def run(batches):
        ids, texts, size = [], [], 0
        for whole in batches:
            for batch in slices(whole):
                asked = []
                for i, text, query in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    words = Counter(words_of(text, ALNUM_FOLD))
                    if not words:
                        continue
                    ids.append(i)
                    texts.append(words)
                    size += len(text)
                    if query:
                        asked.append({"kind": 1, "query_id": i, "terms": np.unique(np.fromiter(map(term, words), np.uint64, len(words))).tobytes()})
                    if size >= SEGMENT_BYTES or len(ids) == SEGMENT_DOCS:
                        yield pa.RecordBatch.from_pylist([segment(ids, texts)], schema)
                        ids, texts, size = [], [], 0
                if asked:
                    yield pa.RecordBatch.from_pylist(asked, schema)
        if ids:
            yield pa.RecordBatch.from_pylist([segment(ids, texts)], schema)

    return rows.mapInArrow(run, INDEX)


class Queries:
    """A group of queries over their common vocabulary. Queries of equal terms are searched as one set; weights are inverse document
    frequencies, floors what a result of a set must reach."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        own: dict[int, list[np.ndarray]] = {}
        for i, terms in rows:
            own.setdefault(i, []).append(np.frombuffer(terms, np.uint64))
        self.ids = sorted(own)
        joined = [np.unique(np.concatenate(own[i])) for i in self.ids]
        self.vocabulary = np.unique(np.concatenate(joined)) if joined else np.zeros(0, np.uint64)
        sets: dict[bytes, int] = {}
        #: The set of each query; queries ordered by set, those of one from first[n] to first[n + 1].
        self.set_of = np.array([sets.setdefault(t.tobytes(), len(sets)) for t in joined], np.int64)
        self.by_set = np.argsort(self.set_of, kind="stable")
        self.first = np.searchsorted(self.set_of[self.by_set], np.arange(len(sets) + 1))
        distinct = [np.frombuffer(t, np.uint64) for t in sets]
        self.at = np.cumsum([0, *map(len, distinct)])
        self.terms = np.searchsorted(self.vocabulary, np.concatenate(distinct)).astype(np.int32) if distinct else np.zeros(0, np.int32)
        self.asked = np.bincount(self.terms, minlength=len(self.vocabulary)).astype(np.int32)
        self.weights = np.zeros(len(self.vocabulary))
        self.mean = 1.0
        self.floors = np.zeros(len(sets))

    def of(self, n: int) -> np.ndarray:
        return self.terms[self.at[self.set_of[n]] : self.at[self.set_of[n] + 1]]

    def raise_floors(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Let the sets of some queries start from their scores."""
        place = np.searchsorted(np.array(self.ids, np.int64), ids)
        np.maximum.at(self.floors, self.set_of[place], scores)

    def weigh(self, found: np.ndarray, documents: int, words: int) -> None:
        self.weights = np.log(1.0 + (documents - found + 0.5) / (found + 0.5))
        self.mean = max(1.0, words / max(1, documents))

    def known(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms the vocabulary has, and where."""
        at = np.searchsorted(self.vocabulary, terms)
        at[at == len(self.vocabulary)] = 0
        return self.vocabulary[at] == terms, at


class Chunk:
    """Blocks of a shard that are searched together: its postings by term and document, cells of a term and block with their largest
    impact, and the terms that are asked for often as columns of all its documents, those that most documents have last."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impact: np.ndarray, documents: int, asked: np.ndarray, queries: int):
        self.docs, self.impact = docs, impact
        self.blocks = -(-documents // BLOCK)
        block = docs // BLOCK
        other = np.diff(terms, prepend=-1) != 0
        self.start, cells = np.flatnonzero(other), np.flatnonzero(other | (np.diff(block, prepend=-1) != 0))
        self.terms, self.size = terms[self.start], np.diff(self.start, append=len(terms))
        self.cell_at, self.cell_block = np.r_[cells, len(terms)], block[cells]
        self.cell_most = np.maximum.reduceat(impact, cells) * np.float32(1 + SLACK) if len(cells) else impact
        self.at = np.searchsorted(cells, self.start)
        self.cells = np.diff(self.at, append=len(cells))
        self.most = np.maximum.reduceat(self.cell_most, self.at) if len(self.at) else impact
        added = self.size * asked[self.terms]
        some = np.flatnonzero(added > COLUMN * documents * queries)
        if len(some) > COLUMNS:
            some = some[np.argpartition(-added[some], COLUMNS)[:COLUMNS]]
        some = some[np.argsort(self.size[some], kind="stable")]
        self.late = int(np.searchsorted(self.size[some], DENSE * documents))
        self.column = np.full(len(self.start), -1, np.int32)
        self.column[some] = np.arange(len(some))
        rows = np.zeros((len(some), self.blocks, BLOCK), np.float32)
        own = _ranges(self.start[some], self.size[some])
        rows.reshape(len(some), self.blocks * BLOCK)[np.repeat(np.arange(len(some)), self.size[some]), docs[own]] = impact[own]
        self.block_most = rows.max(2, initial=0) * np.float32(1 + SLACK)
        self.block_size = np.count_nonzero(rows, 2).astype(np.float32)
        self.rows = np.ascontiguousarray(rows.transpose(1, 0, 2))


class Shard:
    """Postings of the queries' terms in some segments, by chunk and term and by document. copies: how many documents that no
    query of the group tells apart are kept, those of the smallest ids."""

    def __init__(self, segments: list[dict], queries: Queries, copies: int | None = None):
        terms, docs, often, base = [], [], [], 0
        for s in segments:
            held, at = queries.known(np.frombuffer(s["terms"], np.uint64))
            counts = np.frombuffer(s["counts"], np.int32).astype(np.int64)
            own = _ranges((np.cumsum(counts) - counts)[held], counts[held])
            terms.append(np.repeat(at[held].astype(np.int32), counts[held]))
            docs.append(np.frombuffer(s["docs"], np.uint16)[own].astype(np.int32) + base)
            often.append(np.frombuffer(s["often"], np.uint32)[own])
            base += s["documents"]
        ids = np.concatenate([np.frombuffer(s["ids"], np.int64) for s in segments])
        lengths = np.concatenate([np.frombuffer(s["lengths"], np.int64) for s in segments])
        t, d, n = np.concatenate(terms), np.concatenate(docs), np.concatenate(often)
        del terms, docs, often
        if copies:
            kept = _first_copies(t, d, n, ids, lengths, copies)
            own = kept[d]
            t, d, n = t[own], (np.cumsum(kept, dtype=np.int32) - 1)[d[own]], n[own]
            ids, lengths = ids[kept], lengths[kept]
        impact = queries.weights[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[d] / queries.mean))
        self.asked, self.queries = queries.asked, len(queries.floors)
        order = self._together(t, d, impact, np.bincount(t, minlength=len(queries.vocabulary)), lengths)
        self.ids = ids[order]
        self.documents = len(order)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        d = place[d]
        by_doc = np.argsort(d, kind="stable") if len(order) > 1 << 16 else np.argsort(d.astype(np.uint16), kind="stable")  # terms ascend in a document
        self.doc_terms, self.doc_impact = t[by_doc], impact[by_doc]
        self.doc_at = np.searchsorted(d[by_doc], np.arange(len(order) + 1))
        chunk = d // CHUNK
        by_cell = np.argsort((chunk * np.int64(len(queries.vocabulary)) + t) * CHUNK + d % CHUNK)
        self.chunks = -(-len(order) // CHUNK)
        self.chunk_at = np.searchsorted(chunk[by_cell], np.arange(self.chunks + 1))
        self.terms, self.docs, self.impact = t[by_cell], (d % CHUNK).astype(np.int16)[by_cell], impact[by_cell].astype(np.float32)
        self.local = np.full(len(queries.vocabulary), -1, np.int32)
        self.marked = np.zeros(len(queries.vocabulary), bool)
        #: Postings that were added up, and that the queries have.
        self.scored = self.all = 0

    @staticmethod
    def _together(t: np.ndarray, d: np.ndarray, impact: np.ndarray, found: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """An order of the documents by the frequent term that weighs most in them (which tells languages apart), then length."""
        often = np.where(2 * found > len(lengths), 0, found)
        markers = np.argsort(-often, kind="stable")[:MARKERS]
        number = np.full(len(found), -1)
        number[markers] = np.arange(len(markers))
        own = number[t] >= 0
        weight = np.zeros((len(markers) + 1, len(lengths)))
        weight[number[t[own]], d[own]] = impact[own]
        weight[-1] = 1e-300  # documents without a marker
        return np.lexsort((lengths, np.argmax(weight, 0)))

    def _reached(self, chunk: Chunk, at: np.ndarray, terms: np.ndarray, k: int, floors: np.ndarray, top: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries, documents and scores (to SLACK) of a chunk that reach the floors of some queries, which rise. Blocks whose bound
        reaches the floor are pivots; where the chunk's bound is far above the floor, all are, as sums of maxima then leave none out."""
        cell = self.local[terms]
        query = np.repeat(np.arange(len(floors)), np.diff(at))
        held = np.flatnonzero(cell >= 0)
        cell, query = cell[held], query[held]
        self.all += int(chunk.size[cell].sum())
        bound = np.bincount(query, chunk.most[cell], len(floors))
        asking = np.flatnonzero((bound > 0) & (bound >= _reach(floors)))
        if not len(asking):
            return
        turn = np.full(len(floors), -1)
        turn[asking] = np.arange(len(asking))
        query = turn[query]
        if len(asking) < len(floors):
            cell, query = cell[query >= 0], query[query >= 0]
        column = chunk.column[cell]
        own, rare = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
        has = np.zeros((len(asking), len(chunk.block_most)), np.float32)
        has[query[own], column[own]] = 1
        cell, query = cell[rare], query[rare]
        near = bound[asking] <= NEAR * floors[asking]
        near |= floors[asking] <= 0
        if not near.any():
            yield from self._add(chunk, asking, np.ones((len(asking), chunk.blocks), bool), has, chunk.start[cell], chunk.size[cell], query, k, floors, top)
            return
        far = np.flatnonzero(~near[query])
        cells_of = np.flatnonzero(near[query])
        length = chunk.cells[cell[cells_of]]
        cells = _ranges(chunk.at[cell[cells_of]], length)
        place = np.repeat(query[cells_of] * chunk.blocks, length) + chunk.cell_block[cells]
        bound = has @ chunk.block_most
        bound += np.bincount(place, chunk.cell_most[cells], bound.size).reshape(bound.shape)
        bound[~near] = np.inf
        done, blocks = np.zeros(bound.shape, bool), 1
        starting = np.flatnonzero(floors[asking] <= 0)
        while True:
            pivots = (bound > 0) & (bound >= _reach(floors[asking])[:, None]) & ~done
            if len(starting) and blocks < chunk.blocks:  # without a floor, the blocks of the largest bounds go first
                ahead = np.where(pivots[starting], bound[starting], -1)
                pivots[starting] &= ahead >= np.partition(ahead, -blocks, 1)[:, -blocks, None]
            if not pivots.any():
                return
            some = pivots.ravel()[place]
            entries = cells[some]
            start, length, owner = chunk.cell_at[entries], chunk.cell_at[entries + 1] - chunk.cell_at[entries], place[some] // chunk.blocks
            if len(far) and not done.any():
                start, length, owner = (np.concatenate(x) for x in ((start, chunk.start[cell[far]]), (length, chunk.size[cell[far]]), (owner, query[far])))
            yield from self._add(chunk, asking, pivots, has, start, length, owner, k, floors, top)
            done |= pivots
            blocks *= 2

    def _add(self, chunk: Chunk, asking: np.ndarray, pivots: np.ndarray, has: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray, k: int, floors: np.ndarray, top: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What reaches the floors in pivots (asking queries x blocks). Rare terms (ranges of postings, each of an owner) are added
        first, then columns, and those that most documents have only where they can still lift a block's best to the floor."""
        own = _ranges(start, length)
        self.scored += len(own)
        place = np.repeat(owner * (chunk.blocks * BLOCK), length)
        place += chunk.docs[own]
        rare = np.bincount(place, chunk.impact[own], pivots.size * BLOCK)
        rare = rare.astype(float, copy=False).reshape(*pivots.shape, BLOCK)
        low = np.maximum(_reach(floors[asking]), 1e-300)
        late = chunk.late
        lift = has[:, late:] @ chunk.block_most[late:]
        pivots = pivots & (rare.max(2) + has[:, :late] @ chunk.block_most[:late] + lift >= low[:, None])
        count = np.stack([has[:, :late] @ chunk.block_size[:late], has[:, late:] @ chunk.block_size[late:]])
        found = []
        for block in range(chunk.blocks):
            some = np.flatnonzero(pivots[:, block])
            if not len(some):
                continue
            every = len(some) == len(has)
            scores = rare[some, block] + (has if every else has[some])[:, :late] @ chunk.rows[block, :late]
            self.scored += int(count[0, some, block].sum())
            still = np.flatnonzero(scores.max(1) + lift[some, block] >= low[some])
            if len(still) < len(some):
                some, scores = some[still], scores[still]
            self.scored += int(count[1, some, block].sum())
            scores += (has if len(some) == len(has) else has[some])[:, late:] @ chunk.rows[block, late:]
            i, j = np.nonzero(scores >= low[some, None])
            if len(i):
                found.append((some[i], j + block * BLOCK, scores[i, j]))
        if not found:
            return
        query, doc, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-score, query))
        query, doc, score = query[order], doc[order], score[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        size = np.diff(first, append=len(query))
        rank = np.arange(len(query)) - np.repeat(first, size)
        best = np.zeros((len(first), k))
        best[np.repeat(np.arange(len(first)), size)[rank < k], rank[rank < k]] = score[rank < k]
        own = asking[query[first]]
        top[own] = np.partition(np.concatenate([top[own], best], 1), k, 1)[:, k:]
        floors[own] = np.maximum(floors[own], top[own].min(1) * (1 - SLACK))
        query = asking[query]
        some = score >= _reach(floors[query])
        yield query[some], doc[some], score[some]

    def answers(self, at: np.ndarray, terms: np.ndarray, k: int, floors: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries (terms from at[n] to at[n + 1]), rounded scores and ids of the k best of each that reach its floor, by
        query, falling score, then id. floors and top, the k best scores known to SLACK, are brought up to date."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(self.chunks):
            own = slice(self.chunk_at[n], self.chunk_at[n + 1])
            chunk = Chunk(self.terms[own], self.docs[own], self.impact[own], min(CHUNK, self.documents - n * CHUNK), self.asked, self.queries)
            self.local[chunk.terms] = np.arange(len(chunk.terms))
            for a in range(0, len(floors), ASKED):
                b = min(a + ASKED, len(floors))
                for query, doc, score in self._reached(chunk, at[a : b + 1] - at[a], terms[at[a] : at[b]], k, floors[a:b], top[a:b]):
                    found.append((query + a, doc + n * CHUNK, score))
            self.local[chunk.terms] = -1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        query, doc, score = (np.concatenate(x) for x in zip(*found, strict=True))
        some = score >= _reach(floors[query])
        order = np.argsort(query[some], kind="stable")
        query, doc = query[some][order], doc[some][order]
        start = np.flatnonzero(np.diff(query, prepend=-1))
        out = [self._exact(terms[at[query[a]] : at[query[a] + 1]], doc[a:b], k, floors[query[a]]) for a, b in zip(start, np.r_[start[1:], len(query)], strict=True)]
        return np.repeat(query[start], [len(s) for s, _ in out]), *(np.concatenate(x) for x in zip(*out, strict=True))

    def _exact(self, terms: np.ndarray, docs: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rounded scores and ids of the k best of docs that reach the floor: impacts are summed by term, so that equal documents score alike."""
        self.marked[terms] = True
        length = self.doc_at[docs + 1] - self.doc_at[docs]
        own = _ranges(self.doc_at[docs], length)
        hit = self.marked[self.doc_terms[own]]
        scores = np.bincount(np.repeat(np.arange(len(docs)), length)[hit], self.doc_impact[own[hit]], len(docs))
        self.marked[terms] = False
        some = scores >= floor - MARGIN
        rounded, ids = np.round(scores[some], DECIMALS), self.ids[docs[some]]
        first = np.lexsort((ids, -rounded))[:k]
        return rounded[first], ids[first]

    def best(self, terms: np.ndarray, k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Rounded scores and ids of the k best of one query that reach the floor, by falling score, then id."""
        return self.answers(np.array([0, len(terms)]), terms, k, np.array([floor]), np.zeros((1, k)))[1:]


def _reach(floors: np.ndarray) -> np.ndarray:
    """What a score known to SLACK must reach so that the score may reach the floor."""
    return floors * (1 - SLACK) - MARGIN


def _first_copies(t: np.ndarray, d: np.ndarray, n: np.ndarray, ids: np.ndarray, lengths: np.ndarray, copies: int) -> np.ndarray:
    """Which documents are among the first copies by id of those with the same length, terms and counts (told by 64-bit sums)."""
    with np.errstate(over="ignore"):
        mixed = (t.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
    # two exact sums of 32-bit halves: doubles hold sums of 2**21 such numbers
    low, high = (np.bincount(d, x.astype(float), len(ids)) for x in (mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32)))
    order = np.lexsort((ids, lengths, low, high))
    same = (np.diff(low[order]) == 0) & (np.diff(high[order]) == 0) & (np.diff(lengths[order]) == 0)
    first = np.flatnonzero(np.r_[True, ~same])[: len(ids)]
    rank = np.arange(len(ids)) - np.repeat(first, np.diff(first, append=len(ids)))
    kept = np.zeros(len(ids), bool)
    kept[order] = rank < copies
    return kept


def _group(tables: Scratch, index: DataFrame, groups: int, group: int) -> Queries:
    """The queries of a group, with weights from all documents."""
    spark = index.sparkSession
    own = index.where((F.col("kind") == 1) & (F.pmod(F.xxhash64("query_id"), F.lit(groups)) == group)).select("query_id", "terms").distinct().toArrow()
    queries = Queries(list(zip(own.column("query_id").to_pylist(), own.column("terms").to_pylist(), strict=True)))
    shared = spark.sparkContext.broadcast(queries)

    @frugal
    def count(batches):
        queries = shared.value
        found = np.zeros(len(queries.vocabulary), np.int64)
        if len(found):
            for batch in batches:
                for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    held, at = queries.known(np.frombuffer(terms, np.uint64))
                    found[at[held]] += np.frombuffer(counts, np.int32)[held]
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["term", "n"])

    segments = index.where("kind = 0")
    summed = segments.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the group at most
    shared.destroy()
    found = np.zeros(len(queries.vocabulary), np.int64)
    found[summed.column("term").to_numpy()] = summed.column("n").to_numpy()
    total = segments.agg(F.sum("documents"), F.sum("words")).first()
    queries.weigh(found, total[0] or 0, total[1] or 0)
    return queries


def _run(segments: DataFrame, shared, k: int) -> DataFrame:
    def answers(held: list[dict], queries: Queries, floors: np.ndarray, top: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, scores, found = Shard(held, queries, k).answers(queries.at, queries.terms, k, floors, top)
        ids = np.array(queries.ids, np.int64)
        for a in range(0, len(n), ROWS):
            own = slice(a, a + ROWS)
            times = queries.first[n[own] + 1] - queries.first[n[own]]
            q = ids[queries.by_set[_ranges(queries.first[n[own]], times)]]
            d, s = np.repeat(found[own], times), np.repeat(scores[own], times)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, pa.int64(), mask=d == NO_ID), pa.array(s)], ["query_id", "doc_id", "score"])

    @frugal
    def run(batches):
        queries, held, words = shared.value, [], 0
        if not queries.ids:
            return
        floors, top = queries.floors.copy(), np.zeros((len(queries.floors), k))  # they rise from shard to shard
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                words += row["words"]
                if words >= SHARD_WORDS:
                    yield from answers(held, queries, floors, top)
                    held, words = [], 0
        if held:
            yield from answers(held, queries, floors, top)

    return segments.select("documents", "words", "terms", "counts", "ids", "lengths", "docs", "often").mapInArrow(run, RESULT)


def search(docs: DataFrame, is_query: Column, k: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``query_id, rank, doc_id, score``: for each row where is_query holds, its k best among all rows, itself included."""
    spark = docs.sparkSession
    bounded_batches(spark)
    tables = Scratch(spark)
    number = F.col(doc_id).cast("long")
    rows = docs.select(number.alias("doc_id"), F.col(text).alias("text"), F.coalesce(is_query & number.isNotNull(), F.lit(False)).alias("asked"))
    index = tables.cut(_index(rows), "index")
    size = index.agg(F.sum(F.octet_length("terms") * (F.col("kind") == 1).cast("int")), F.sum((F.col("kind") == 0).cast("int"))).first()
    groups = 1 + int((size[0] or 0) // (8 * GROUP_TERMS))
    every = -(-(size[1] or 0) // max(PILOTS, (size[1] or 0) // PILOT_SHARE))
    pilot = F.pmod(F.xxhash64("ids"), F.lit(max(1, every))) == 0
    segments = index.where("kind = 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found: DataFrame | None = None
    for group in range(groups):
        queries = _group(tables, index, groups, group)
        shared = spark.sparkContext.broadcast(queries)
        if every > 2:
            first = tables.cut(_run(segments.where(pilot), shared, k), f"pilot{group}")
            shared.destroy()
            reached = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", "score").toArrow()  # a row for each query of the group at most
            queries.raise_floors(reached.column("query_id").to_numpy(), reached.column("score").to_numpy())
            shared = spark.sparkContext.broadcast(queries)
            part = tables.cut(_run(segments.where(~pilot), shared, k), f"found{group}").unionByName(first)
        else:
            part = tables.cut(_run(segments, shared, k), f"found{group}")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    tables.drop("index")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
