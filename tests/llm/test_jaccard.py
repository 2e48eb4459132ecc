import random
import re

import numpy as np
import pytest

from tidemark.llm import jaccard

SCHEMA = "doc_id long, text string, n long, h string, component_id int"


def shingles(text, n):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, n, percent):
    sets = [shingles(t, n) for _, t, *_ in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(docs):
        if d[0] is not None:
            least[find(i)] = min(d[0], least.get(find(i), d[0]))
    return sorted(((d[0], len(s), least.get(find(i)) if s else d[0]) for i, (d, s) in enumerate(zip(docs, sets))), key=str)


def case(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda m: [rng.choice(vocabulary) for _ in range(m)]
    passage = text(40)
    docs = []
    for base in [text(rng.randint(20, 160)) for _ in range(12)]:
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append(" ".join(w))
    hot = text(120)
    for _ in range(60):
        w = list(hot)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append(" ".join(w))
    docs += [" ".join(passage + text(rng.randint(1, 60))) for _ in range(40)]
    chain = text(100)
    for k in range(25):  # neighbours link, ends do not
        chain = chain[:k] + [f"c{k}"] + chain[k + 1 :]
        docs.append(" ".join(chain))
    docs += [docs[3]] * 15 + [docs[5].upper().replace("W", "w"), "one", "One", "one two", "one  two", " \t\n", "", None, None, "\x1fone"]
    rows = [(i * 3 % 1009, t, 1, "x", 2) for i, t in enumerate(docs)]
    return [*rows, (None, docs[0], 1, "x", 2), (None, "lonely words of no one", 1, "x", 2), rows[0], (7, docs[70], 1, "x", 2)]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_components_against_brute_force(spark, n, percent):
    docs = case(n)
    out = jaccard.join(spark.createDataFrame(docs, SCHEMA).repartition(4), n, percent).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)
    assert got == brute(docs, n, percent)


def test_columns_cut_in_parts_lose_no_link(spark, monkeypatch):
    docs = case(11)
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "HELD", 7)
    monkeypatch.setattr(jaccard, "SIDE", 9)
    monkeypatch.setattr(jaccard, "FILTER_IDS", 3)
    out = jaccard.join(spark.createDataFrame(docs, SCHEMA).repartition(2), 4, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(docs, 4, 85)


def test_large_group_below_the_threshold(spark, monkeypatch):
    """Long documents that share three quarters of a template do not link, some closer ones do, one very long text neither."""
    rng = random.Random(4)
    template = [f"t{rng.randrange(10**6)}" for _ in range(2000)]
    docs = []
    for i in range(60):
        w = list(template)
        for k in rng.sample(range(2000), rng.choice((30, 60, 80, 90))):
            w[k] = f"u{rng.randrange(10**6)}"
        docs.append((i, " ".join(w), 1, "x", 2))
    docs.append((60, " ".join(docs[7][1].split(" ")[:1900]), 1, "x", 2))
    docs.append((61, "long " * 300_000 + " ".join(template), 1, "x", 2))
    monkeypatch.setattr(jaccard, "SIDE", 25)
    out = jaccard.join(spark.createDataFrame(docs, SCHEMA).repartition(3), 4, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(docs, 4, 85)


def test_forest_spans_what_its_edges_connect():
    rng = np.random.default_rng(0)
    a, b, w = rng.integers(0, 200, 500), rng.integers(0, 200, 500), rng.random(500)
    kept = jaccard.spanning_forest(200, a, b, w)

    def roots(edges):
        root = list(range(200))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        joined = 0
        for i in edges:
            x, y = find(a[i]), find(b[i])
            joined += x != y
            root[x] = y
        return joined, [find(i) for i in range(200)]

    joined, whole = roots(range(500))
    spanned, part = roots(kept)
    assert spanned == joined == len(kept) and len(set(zip(whole, part))) == len(set(whole)) == len(set(part))


def test_keep_one_keeps_the_smallest_id_and_empty_texts(spark):
    docs = [(3, "a b c d e f", 1, "x", 2), (2, "A b c d e f", 1, "y", 3), (2, "A b c d e f", 1, "y", 3), (None, "a b c d e f", 1, "x", 2), (9, "", 1, "x", 2), (9, None, 1, "x", 2), (9, "", 1, "x", 2), (None, "of no one else", 1, "x", 2)]
    kept = jaccard.keep_one(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted((tuple(r) for r in kept), key=str) == sorted([docs[1], docs[4], docs[5], docs[6], docs[7]], key=str)


def test_no_documents(spark):
    assert jaccard.join(spark.createDataFrame([], SCHEMA)).collect() == []
