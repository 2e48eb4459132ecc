import hashlib
import random
import re

import pytest

from tidemark.llm import decontaminate


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            n = min(10, len(b))
            for k in range(len(b) - n + 1 if b and item is not None else 0):
                for a in range(len(w) - n + 1):
                    if w[a : a + n] == b[k : k + n]:
                        hit |= set(range(a, a + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "The", "é", "x1", "zz"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 9, 10, 12, 25]))) for i in range(12)] + [(20, None), (21, ""), (22, "?!"), (None, "a b"), (23, "q w e r t y u i o p"), (23, "q w e r t y u i o p"), (24, " ".join(["rare"] * 15))]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "x, Q-W e\nr t Y u i o p? q w e r t y u i o"), (None, items[7][1]), (63, "rare " * 40), (64, "rare " * 9), (0, docs[0][1]), (65, "nothing here " * 20_000 + items[6][1])]
    return docs, items


@pytest.mark.parametrize("block", [500_000, 30])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    docs, items = case(block)
    items = [x for x in items if x[1] is None or len(words(x[1])) > 2 or block == 30]
    d = spark.createDataFrame([(*x, "extra", 1) for x in docs], "doc_id long, text string, items string, hits int").repartition(3)
    b = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, hits string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.find(d, b).collect()), key=str)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.find(d.limit(0), b).collect() == []
    (row,) = decontaminate.find(d, b.limit(0)).collect()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 0, 0, False)
