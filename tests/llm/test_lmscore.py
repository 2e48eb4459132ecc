import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lmscore, queries

SCHEMA = "doc_id long, text string, word string, block int, n int"
WORDS = "the of and une là où größe tide mark market score words learned from counts".split()


def tokens(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", folded) + [None]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


def base(rows):
    known = Counter(w for d, t in rows if d is not None and not held(d) for w in tokens(t))
    n, v = sum(known.values()), len(known)
    return {i: (held(d), len(tokens(t)), sum(known[w] > 0 for w in tokens(t)), n, sum(math.log10((known[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for i, (d, t) in enumerate(rows)}


def plain(code, model, texts):
    """The mixing of one text after the other, one decision after the other, in Python floats."""
    out = []
    for text in texts:
        words = [w.encode() if w is not None else lmscore.END for w in tokens(text)]
        weights = [list(lmscore.FIRST[g // 4]) for g in range(lmscore.GATES)]
        cells, total = [0.0] * lmscore.CELLS, 0.0
        for first in range(0, len(words), lmscore.STEP):
            steps = []
            for w in words[first : first + lmscore.STEP]:
                d = lmscore.decisions([w], code, model.bits)
                for j in range(int(d.sizes[0])):
                    x = [int(model.slots[i][d.slots[i][j]]) / lmscore.UNIT for i in range(lmscore.CONTEXTS)]
                    gate = int(d.place[j]) + 4 * (x[-1] != 0)
                    z = sum(a * b for a, b in zip(weights[gate], x, strict=True))
                    cell = min(lmscore.CELLS - 1, max(0, int(max(0, z + lmscore.CELLS // 2))))
                    z = max(-20, min(20, z + cells[cell]))
                    p = 1 / (1 + math.exp(-z))
                    total += math.log10(p if d.bits[j] else 1 - p)
                    steps.append((gate, cell, x, int(d.bits[j]) - p))
            for gate, cell, x, miss in steps:
                weights[gate] = [a + lmscore.RATE * miss * b for a, b in zip(weights[gate], x, strict=True)]
                cells[cell] += lmscore.MAP_RATE * miss
        out.append(total)
    return out


def corpus(rng, n):
    return [(i, " ".join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=rng.choice([1, 3, 40, 90])))) for i in range(n)]


def test_counts_base_scores_and_edges(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = corpus(rng, 60) + [(900, None), (901, ""), (902, " \t\n "), (None, "The Of"), (903, "THE Off\x00 x\x1fy Ä Ä"), (904, "z" * 70_000), (905, "tide mark " * 20_000), (906, None)]
    rows += [rows[4]] * 3
    spark.createDataFrame([(d, t, "w", 1, 2) for d, t in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 5000)
    want = base(rows)
    found = queries.op12_lmscore(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    key = lambda d, s: (str(d), round(s, 6))
    got = Counter((key(r.doc_id, r.base_score), r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in found)
    assert got == Counter((key(rows[i][0], w[4]), *w[:4]) for i, w in want.items())
    assert all(r.score < 0 and math.isfinite(r.score) and r.bits_per_byte > 0 for r in found)
    empty = {r.score for r in found if r.doc_id in (900, 901, 902, 906)}
    assert len(empty) == 1  # only the end, whichever way a text is empty
    assert len({r.score for r in found if r.doc_id == 4}) == 1


def words_of(rows):
    return Counter(w if w is not None else "\n" for d, t in rows if d is not None and not held(d) for w in tokens(t))


def test_scores_equal_a_plain_mixing_and_do_not_hang_on_blocks(spark, monkeypatch):
    rows = corpus(random.Random(3), 30) + [(500, "größe unseen wörds"), (501, "tide " * 400), (502, None)]
    df = spark.createDataFrame([(d, t, "w", 1, 2) for d, t in rows], SCHEMA)
    counts = spark.createDataFrame([(bytearray(w.encode()), n) for w, n in words_of(rows).items()], "word binary, n long")
    model = lmscore.learn(counts)
    want = plain(model.code, model, [t for _, t in rows])
    for size, parts in ((1 << 20, 1), (300, 4)):
        monkeypatch.setattr(lmscore, "BLOCK_BYTES", size)
        got = {r.doc_id: r.score for r in lmscore.score(df.repartition(parts), queries.scored_apart()).collect()}
        assert all(got[d] == pytest.approx(s, rel=2e-4) for (d, _), s in zip(rows, want, strict=True))


def test_slots_hold_the_counts_of_all_words(spark, monkeypatch):
    rows = corpus(random.Random(4), 25)
    known = words_of(rows)
    counts = spark.createDataFrame([(bytearray(w.encode()), n) for w, n in known.items()], "word binary, n long")
    one = lmscore.learn(counts)
    monkeypatch.setattr(lmscore, "SHARE", 5)  # many tasks
    many = lmscore.learn(counts)
    words = [w.encode() for w in known]
    d = lmscore.decisions(words, one.code, one.bits)
    sums = [np.zeros((1 << b, 2)) for b in one.bits]
    for i in range(lmscore.CONTEXTS):
        np.add.at(sums[i], (d.slots[i], d.bits), np.repeat([known[w.decode()] for w in words], d.sizes))
        assert (lmscore.stretched(sums[i]) == one.slots[i]).all() and (one.slots[i] == many.slots[i]).all()


def test_predictions_of_all_words_sum_to_one(spark):
    """Every byte has a path of its own, so what follows is a distribution: the code's lengths fill the tree."""
    follows = np.zeros((256, 256), np.int64)
    follows[97, 98], follows[97, 32], follows[32, 97] = 10**15, 3, 7
    code = lmscore.make_code(follows)
    for row in range(256):
        assert sum(2.0 ** -int(n) for n in code.length[row * 256 : (row + 1) * 256]) == 1.0
    assert code.length.max() < 40


def test_learned_texts_are_likelier_and_repetition_is_learned(spark):
    rows = corpus(random.Random(5), 80)
    df = spark.createDataFrame([(d, t, "w", 1, 2) for d, t in rows] + [(2000, "qzx vkjw " * 60, "w", 1, 1), (2001, "qzx vkjw", "w", 1, 1)], SCHEMA)
    out = {r.doc_id: r.bits_per_byte for r in lmscore.score(df, F.col("doc_id") >= 2000).collect()}
    assert max(out[d] for d, t in rows if len(t) > 100) < out[2000] < out[2001]


def test_empty_table_and_nothing_learned(spark):
    df = spark.createDataFrame([(1, "a bc", "w", 1, 1), (None, None, "w", 1, 1)], SCHEMA)
    assert lmscore.score(df.limit(0), F.lit(False)).count() == 0
    for r in lmscore.score(df, F.lit(True)).collect():
        assert r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0
        assert r.score == pytest.approx(math.log10(0.5) * 8 * (7 if r.doc_id else 2), rel=1e-6)
