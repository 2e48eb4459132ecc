import re

from tidemark.llm import licenses

TEXTS = [
    "This is under the MIT License. mit-license MIT  LICENSE!",
    "GNU General Public License, general public license general public\nLICENSE",
    "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception */",
    "submit license; apache licenses",
    "é mit license é",
    "Apache license" + " filler" * 40_000 + " apache license",
    "",
    None,
    "SPDX-License-Identifier:\nmit",
]


def brute(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    starts = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + phrase.count(" ") + 1] == phrase.split()]
    at = [i for i, _ in starts]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in starts}))


def test_against_brute_force(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], "x", 1), (0, TEXTS[0], "x", 1)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words int")).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=str)
    assert got == sorted(((i, *brute(t)) for i, t, *_ in rows), key=str)
    for r in out:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    tagged = next(r for r in out if r.doc_id == 2)
    assert tagged.labels == "apache-2.0,gpl-2.0-only,mit"
    assert tagged.permitted is True and tagged.expressions == ["mit gpl-2.0-only or apache-2.0 llvm-exception with and"]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_parser():
    p = licenses.parse_expression
    assert p("MIT") == ["mit"]
    assert p("A or B and C with D") == ["a", "b", "c", "d", "with", "and", "or"]
    assert p("(A or B) and C") == ["a", "b", "or", "c", "and"]
    assert p("A or") == ["a"] and p("A or (B") == ["a"] and p("A B") == ["a"]
    assert p("") is None and p("and A") is None and p("(A") is None and p(") A") is None
    assert licenses.permits(p("GPL-3.0 or MIT"), {"mit"}) and not licenses.permits(p("GPL-3.0 and MIT"), {"mit"})
    assert licenses.permits(p("MIT with X"), {"mit"})


def test_tags_without_an_identifier_give_no_label():
    automaton = licenses.build_automaton(licenses.BASE_PHRASES, licenses.MORE_PHRASES)
    for tag in (" ...", " -", " .", ""):
        assert licenses.scan_text(f"MIT License SPDX-License-Identifier:{tag}".encode(), automaton)[4:6] == ("mit", "mit")
    assert licenses.parse_expression("MIT. - (see there") == ["mit"]
