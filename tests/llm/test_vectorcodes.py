import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import queries, vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error double"


def brute(rows, entries=256, rounds=4, parts=4):
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // parts
    part = lambda v, p: v[p * d : (p + 1) * d]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = [near(part(v, p), books[p])[1] for _, v, _ in kept]
            books[p] = [[sum(c) // len(c) for c in zip(*mine, strict=True)] if (mine := [part(v, p) for (_, v, _), a in zip(kept, at, strict=True) if a == e]) else books[p][e] for e in range(len(books[p]))]
    found = [[near(part(v, p), books[p]) for p in range(parts)] for _, v, _ in kept]
    error = [sum(x for x, _ in f) for f in found]
    sums = {}
    for (_, _, lab), x in zip(kept, error, strict=True):
        sums[lab] = sums.get(lab, 0) + x
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{e:02x}" for _, e in f), x, sums[lab], digest) for (i, _, lab), f, x in zip(kept, found, error, strict=True))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA).repartition(3)


def run(spark, rows, **options):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vectorcodes.compress(frame(spark, rows), **options).collect())


def vectors(rng, n, width=8):
    # float32 values in eighths, so that ties abound, and free ones
    return [(i, [rng.randint(-9, 9) / 8 if i % 2 else float(np.float32(rng.uniform(-1, 1))) for _ in range(width)], rng.choice([0, 0, 0, 1, None])) for i in range(n)]


def test_brute_force_with_ties_nulls_and_repeats(spark):
    rows = vectors(random.Random(1), 150)
    odd = [(900, None, 1), (901, [0.5, None] * 4, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] * 8, 0), (904, [-float("inf")] * 8, 0), (None, rows[3][1], None), (905, [0.0] * 8, 7)]
    rows += [*odd, rows[5], rows[5], (906, rows[5][1], 1)]
    assert run(spark, rows, entries=16) == brute(rows, 16)
    assert run(spark, rows[:20], rounds=2) == brute(rows[:20], rounds=2)


def test_more_entries_than_vectors_and_empty(spark):
    assert run(spark, []) == []
    rows = vectors(random.Random(2), 3)
    assert run(spark, rows) == brute(rows)
    with pytest.raises(ValueError):
        vectorcodes.compress(frame(spark, rows), entries=257)


def test_vectors_that_have_no_code(spark):
    rows = vectors(random.Random(3), 12) + [(50, [1.0] * 4, 0), (51, [3e38] * 8, 0), (52, [], 9)]
    out = {r[0]: r for r in run(spark, rows)}
    assert len(out) == 15 and all(out[i][1] is None and out[i][2] is None for i in ("50", "51", "52")) and out["52"][3] is None
    want = {r[0]: r[1:3] for r in brute(rows[:12])}
    assert {i: out[i][1:3] for i in want} == want
    assert {r[1] for r in run(spark, [(1, [1.0] * 6, 0), (2, [1.0] * 8, 0)])} == {None}  # six components are no four parts


def test_tree_equals_a_scan_of_all_entries():
    rng = np.random.default_rng(4)
    for spread in (3, 50, 1 << 26):
        book = rng.integers(-spread, spread, (256, 5), endpoint=True)
        book[100:140] = book[:40]  # repeated entries: the lower index must win
        x = np.r_[rng.integers(-spread, spread, (700, 5), endpoint=True), book[90:150]]
        d2 = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        index, best = vectorcodes.nearest(vectorcodes.ball(book, np.arange(256)), book, x)
        assert (index == d2.argmin(axis=1)).all() and (best == d2.min(axis=1)).all()


def test_balls_hold_their_entries_and_searches_leave_some_out(monkeypatch):
    rng = np.random.default_rng(5)
    book = np.concatenate([rng.integers(-5, 5, (32, 6)) + 1000 * rng.integers(-9, 9, 6) for _ in range(8)])
    tree = vectorcodes.ball(book, np.arange(256))
    waiting, leaves = [tree], []
    while waiting:
        node = waiting.pop()
        assert np.sqrt(((book[node.entries] - node.centre) ** 2).sum(axis=1)).max() <= node.radius
        waiting += node.kids
        leaves += [] if node.kids else [*node.entries]
    assert sorted(leaves) == [*range(256)]
    compared = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            compared.append(1)
            return super().__getitem__(key)

    vectorcodes.nearest(tree, book.view(Counting), book[:1])
    assert len(compared) < 64  # of 256 entries


def test_query(spark, tmp_path):
    rows = vectors(random.Random(6), 30)
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op11_codes(spark, str(tmp_path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(lambda r: (str(r[0]), *r[1:]), out.collect())) == brute(rows)
