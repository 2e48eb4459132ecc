"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags in the words of a text, a
shunting-yard parser reads the expressions behind the tags.

Words are runs of ASCII alphanumerics and non-ASCII characters, A-Z folded. Phrases match whole consecutive words, also
where they overlap. Null and empty texts have no words and no labels. Rows are independent: repeated rows give repeated
results, an empty table an empty one. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import ALNUM_FOLD, map_batches, utf8, words_of

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases that add labels only.
MORE_PHRASES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person": "mit",
    "isc license": "isc",
    "boost software license": "bsl-1.0",
    "creative commons": "cc",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
TAG_PHRASE = "spdx license identifier"
TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
#: Labels under which a text may be used freely; an expression is permitted when it can be met by these alone.
PERMISSIVE = frozenset({"mit", "apache", "apache-2.0", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "bsl-1.0", "unlicense", "cc0-1.0", "zlib", "public-domain"})
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, expressions array<string>, permitted boolean"
)


def parse_expression(text: str) -> list[str] | None:
    """The longest start of text that is a license expression, in postfix order; None if there is none.

    Tokens are identifiers, parentheses and the operators or, and, with in any case. Reading stops at a token that cannot
    stand at its place; operators and open parentheses left without an operand are dropped with what follows them.
    """
    out: list[str] = []
    ops: list[str] = []
    good: list[str] | None = None
    operand = False
    for m in TOKEN.finditer(text):
        token = m[0]
        word = token.lower()
        if word in PRECEDENCE:
            if not operand:
                break
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[word]:
                out.append(ops.pop())
            ops.append(word)
            operand = False
        elif token == "(":
            if operand:
                break
            ops.append("(")
        elif token == ")":
            if not operand or "(" not in ops:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
        else:
            if operand:
                break
            out.append(word.rstrip("."))
            operand = True
        if operand and "(" not in ops:
            good = [*out, *reversed(ops)]
    return good


def permits(postfix: list[str], allowed: Iterable[str]) -> bool:
    """Whether the licenses in allowed meet an expression; an exception (with) only widens its license."""
    allowed = set(allowed)
    stack: list[bool] = []
    for token in postfix:
        if token in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if token == "or" else a and b if token == "and" else a)
        else:
            stack.append(token in allowed)
    return stack[0]


def expression_licenses(postfix: list[str]) -> set[str]:
    """Identifiers of licenses in an expression, without exceptions."""
    stack: list[set[str]] = []
    for token in postfix:
        if token in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            stack.append(a if token == "with" else a | b)
        else:
            stack.append({token})
    return stack[0]


def build_automaton(base: dict[str, str], more: dict[str, str]) -> ahocorasick.Automaton:
    """Phrases with a space on both sides, so that only whole words match; values: words, base label, other label, tag."""
    automaton = ahocorasick.Automaton()
    for phrase in {*base, *more, TAG_PHRASE}:
        automaton.add_word(f" {phrase} ", (phrase.count(" ") + 1, len(phrase) + 2, base.get(phrase), more.get(phrase), phrase == TAG_PHRASE))
    automaton.make_automaton()
    return automaton


def scan_text(text: bytes | None, automaton: ahocorasick.Automaton, allowed: frozenset[str] = PERMISSIVE) -> tuple:
    """Fields of SCHEMA after doc_id."""
    words = words_of(text, ALNUM_FOLD)
    joined = " " + b" ".join(words).decode("utf-8", "replace") + " "
    base: list[tuple[int, str]] = []
    labels: set[str] = set()
    tagged = False
    seen, at = 0, 0
    for end, (_, length, base_label, label, tag) in automaton.iter(joined):
        begin = end - length + 1
        seen, at = (seen + joined.count(" ", at, begin), begin) if begin >= at else (joined.count(" ", 0, begin), begin)
        if base_label:
            base.append((seen, base_label))
        if label:
            labels.add(label)
        tagged |= tag
    postfixes = []
    if tagged:
        postfixes = [p for m in TAG.finditer(text.decode("utf-8", "replace")) if (p := parse_expression(m[1]))]
    for p in postfixes:
        labels |= expression_licenses(p)
    base_labels = {label for _, label in base}
    labels |= base_labels
    starts = [s for s, _ in base]
    found = len(base) + (len(labels) > len(base_labels))
    score = 1.0 if postfixes else 1.0 - 0.5**found
    permitted = (all(permits(p, allowed) for p in postfixes) if postfixes else labels <= allowed) if labels else None
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, [" ".join(p) for p in postfixes], permitted


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: dict[str, str] | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """Per row: columns of SCHEMA. n_base counts the places of base phrases, first_word and last_word are their smallest
    and largest start in words; expressions are postfix; permitted is null without labels."""
    base = BASE_PHRASES if base is None else base
    more = MORE_PHRASES if more is None else more

    def make():
        automaton = build_automaton(base, more)
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.bool_()]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scan_text(t, automaton) for t in utf8(batch.column(1))]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types[1:], strict=True))]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permitted"])

        return step

    return map_batches(docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text"), make, SCHEMA)
