"""Secret scan with a trigram index.

Each rule's regular expression gives a Boolean query of trigrams (alternatives of sets that must all occur). A task builds
an inverted index of the trigrams that any query names over each batch of texts, intersects and unites postings into the
candidate texts of every rule, and verifies those with the expression. Rules without mandatory trigrams scan every text.
Texts are read whole; an index spans one batch, so its memory is bounded and lost tasks simply rebuild it.

Null texts count as empty. Repeated rows give repeated results, an empty table an empty one. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import ASCII_LOWER, code_point_offsets, slices

#: Strings that the literal part of an expression may spell before its query is cut there.
MAX_STRINGS = 64
#: Bytes of text that an index spans.
INDEX_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group whose length must reach min_chars, 0 for the whole match.
    group: int = 0
    min_chars: int = 1


#: Kinds that every digest covers, in order. Runs of hexadecimal digits are maximal, so "24 or more" is part of the pattern.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

Query = frozenset  # of frozensets of trigrams: any of the sets, all of its trigrams; empty: no condition


def _strings(items) -> tuple[list[set[str]], bool]:
    """Runs of strings that a parsed sequence spells in turn, each run a set of alternatives; whether one run is all of it."""
    runs: list[set[str]] = [{""}]
    exact = True

    def stop() -> None:
        nonlocal exact
        exact = False
        if runs[-1] != {""}:
            runs.append({""})

    def extend(more: set[str]) -> None:
        if len(runs[-1]) * len(more) > MAX_STRINGS:
            stop()
        if len(more) <= MAX_STRINGS:
            runs[-1] = {a + b for a in runs[-1] for b in more}
        else:
            stop()

    for kind, value in items:
        if kind is op.LITERAL:
            extend({chr(value).lower()})
        elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
            extend({chr(v).lower() for _, v in value})
        elif kind is op.IN:
            stop()
        elif kind is op.SUBPATTERN:
            inner, whole = _strings(value[3])
            if whole:
                extend(inner[0])
            else:
                stop()
                runs[-1:] = [*inner, {""}]
        elif kind is op.BRANCH:
            parts = [_strings(b) for b in value[1]]
            if all(whole for _, whole in parts):
                extend(set().union(*(inner[0] for inner, _ in parts)))
            else:
                stop()
        elif kind is op.MAX_REPEAT:
            low, high, inner = value
            spelt, whole = _strings(inner)
            if whole and (low, high) == (0, 1):
                extend(spelt[0] | {""})
            elif whole and low == high and low <= 8:
                for _ in range(low):
                    extend(spelt[0])
            else:
                stop()
        else:
            stop()
    return [r for r in runs if r != {""}] or [{""}], exact


def trigram_query(pattern: str) -> Query:
    """The run of strings with the fewest alternatives that all have trigrams; no condition if there is none."""
    runs, _ = _strings(parser.parse(pattern))
    usable = [r for r in runs if all(len(s.encode()) >= 3 for s in r)]
    if not usable:
        return frozenset()
    best = min(usable, key=lambda r: (len(r), -min(map(len, r))))
    return frozenset(frozenset(b[i : i + 3] for i in range(len(b) - 2)) for b in (s.encode().translate(ASCII_LOWER) for s in best))


def _code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


class BatchIndex:
    """Postings of the wanted trigrams over the texts of a batch."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = wanted
        self.lower = np.frombuffer(ASCII_LOWER, np.uint8)

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        if len(data) < 3:
            return {}
        low = self.lower[data].astype(np.int32)
        codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
        at = np.flatnonzero(self.wanted[codes])
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + 2 < offsets[text + 1]
        pairs = np.unique(codes[at[inside]].astype(np.int64) << 32 | text[inside])
        codes, texts = pairs >> 32, pairs & 0xFFFFFFFF
        begins = np.flatnonzero(np.diff(codes, prepend=-1))
        return dict(zip(codes[begins].tolist(), np.split(texts, begins[1:]), strict=True)) if len(pairs) else {}


def candidates(query: Query, postings: dict[int, np.ndarray]) -> np.ndarray:
    """Texts that meet a query; ascending."""
    none = np.empty(0, np.int64)
    found = none
    for trigrams in query:
        lists = sorted((postings.get(_code(t), none) for t in trigrams), key=len)
        both = lists[0]
        for other in lists[1:]:
            both = np.intersect1d(both, other, assume_unique=True)
        found = np.union1d(found, both)
    return found.astype(np.int64)


def spans_of(rule: Rule, expression: re.Pattern, text: bytes) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches in bytes; those too short are dropped after they matched."""
    return [m.span() for m in expression.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.min_chars]


def digest(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """kind:start:end by start, then kind."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: tuple[Rule, ...] = BASE_RULES, more: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """Per row: doc_id, a count n_<kind> for each base rule, base_sha256 of the base spans' digest, spans (the digest of all
    rules' spans, in code points, ends exclusive)."""
    rules = [*base, *more]
    kinds = [r.kind for r in rules]
    queries = [trigram_query(r.pattern) for r in rules]
    counts = [f"n_{r.kind}" for r in base]

    def run(batches):
        wanted = np.zeros(1 << 24, bool)
        for q in queries:
            for trigrams in q:
                wanted[[_code(t) for t in trigrams]] = True
        index = BatchIndex(wanted)
        expressions = [re.compile(r.pattern.encode()) for r in rules]
        for whole in batches:
            for batch in slices(whole, INDEX_BYTES):
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                offsets = np.zeros(len(texts) + 1, np.int64)
                np.cumsum([len(t) for t in texts], out=offsets[1:])
                postings = index.postings(np.frombuffer(b"".join(texts), np.uint8), offsets)
                spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for k, (rule, query, expression) in enumerate(zip(rules, queries, expressions, strict=True)):
                    for i in candidates(query, postings).tolist() if query else range(len(texts)):
                        spans[i] += [(a, k, b) for a, b in spans_of(rule, expression, texts[i])]
                for i, found in enumerate(spans):
                    if found and not texts[i].isascii():
                        ends = code_point_offsets(texts[i], [p for a, _, b in found for p in (a, b)])
                        spans[i] = [(ends[2 * j], k, ends[2 * j + 1]) for j, (_, k, _) in enumerate(found)]
                base_spans = [[s for s in found if s[1] < len(base)] for found in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)]
                    + [pa.array([sum(s[1] == k for s in found) for found in base_spans], pa.int64()) for k in range(len(base))]
                    + [pa.array([hashlib.sha256(digest(s, kinds).encode()).hexdigest() for s in base_spans]), pa.array([digest(s, kinds) for s in spans])],
                    ["doc_id", *counts, "base_sha256", "spans"],
                )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string"
    return docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text").mapInArrow(run, schema)
