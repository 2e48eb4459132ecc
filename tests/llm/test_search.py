import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import search


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(rows, k):
    docs = [(i, words(t)) for i, t, *_ in rows if words(t)]
    mean = sum(len(w) for _, w in docs) / max(1, len(docs))
    df = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    asked = {}
    for i, w in docs:
        if i is not None and i % 10 == 0:
            asked.setdefault(i, set()).update(w)
    for q, terms in ((i, sorted(w)) for i, w in asked.items()):
        scored = []
        for i, w in docs:
            s = sum(math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms if t in w)
            if s > 0:
                scored.append((-round(s, 9), i is None, i))
        out += [(q, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def case(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 80))), "x", 1) for i in range(n)]
    rows += [(1000 + i, rows[20][1].upper(), "x", 1) for i in range(30)] + [(None, rows[10][1], "x", 1), (2000, None, "x", 1), (2010, "", "x", 1), (2020, "?!", "x", 1), (2030, "unseen é", "x", 1), rows[30], (2031, "w1 " * 30_000, "x", 1)]
    return rows


@pytest.mark.parametrize(("group", "segment", "pilots"), [(2_000_000, 4 << 20, 8), (300, 1500, 3)])
def test_against_brute_force(spark, monkeypatch, group, segment, pilots):
    monkeypatch.setattr(search, "GROUP_TERMS", group)
    monkeypatch.setattr(search, "SEGMENT_BYTES", segment)
    monkeypatch.setattr(search, "SHARD_WORDS", segment // 2)
    monkeypatch.setattr(search, "PILOTS", pilots)
    rows = [*case(group % 7, 250), (40, "two rows of one id w1 w2 w3", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, rank int").repartition(3)
    got = sorted((r.query_id, r.rank, r.doc_id, r.score) for r in search.search(df, F.col("doc_id") % 10 == 0, 7).where("doc_id is not null").collect())
    want = sorted(x for x in brute(rows, 7) if x[2] is not None)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-8)


def languages(seed, n):
    """Documents of four vocabularies; a few have near copies."""
    rng = random.Random(seed)
    own = [[f"{x}{int(rng.paretovariate(0.5))}" for _ in range(3000)] for x in "abcd"]
    rows = []
    for i in range(n):
        words = own[i % 4]
        w = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        rows += [(100 * i + j, w[: len(w) - j]) for j in range(12 if i % 50 == 0 else 1)]
    return rows


def test_pruned_blocks_hold_none_of_the_best():
    rows = languages(5, 3000)
    counted = [Counter(x.encode() for x in w) for _, w in rows]
    parts = [search.segment([i for i, _ in rows[a : a + 1000]], counted[a : a + 1000]) for a in range(0, len(rows), 1000)]
    asked = [search.np.array(sorted(map(search.term, set(c))), search.np.uint64).tobytes() for c in counted[:100]]
    queries = search.Queries([(i, t) for (i, _), t in zip(rows, asked)])
    found = search.np.zeros(len(queries.vocabulary))
    for part in parts:
        held, at = queries.known(search.np.frombuffer(part["terms"], search.np.uint64))
        found[at[held]] += search.np.frombuffer(part["counts"], search.np.int32)[held]
    queries.weigh(found, len(rows), sum(len(w) for _, w in rows))
    shard = search.Shard(parts, queries)
    lengths = {i: len(w) for i, w in rows}
    position = {i: n for n, (i, _) in enumerate(rows)}
    for n in range(len(queries.ids)):
        terms = queries.of(n)
        full = []
        words = {search.term(w): w for w in (x.encode() for x in rows[position[queries.ids[n]]][1])}
        weight = {words[int(queries.vocabulary[t])]: queries.weights[t] for t in terms}
        for (i, _), c in zip(rows, counted):
            score = sum(v * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * lengths[i] / queries.mean)) for w, v in weight.items() if c[w])
            if score:
                full.append((-round(score, 9), i))
        want = sorted(full)[:10]
        for floor in (0.0, -want[-1][0] if len(want) == 10 else 0.0):
            scores, ids = shard.best(terms, 10, floor)
            assert ids.tolist() == [i for _, i in want] and scores.tolist() == pytest.approx([-s for s, _ in want], abs=1e-8)
    assert shard.scored < 0.8 * shard.all


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert search.search(df, F.col("doc_id") % 10 == 0).collect() == []


def indexed(rows, asked, step=1000):
    """Segments of rows of an id and words, and the queries of those asked for, weighed."""
    counted = [Counter(x.encode() for x in w) for _, w in rows]
    parts = [search.segment([i for i, _ in rows[a : a + step]], counted[a : a + step]) for a in range(0, len(rows), step)]
    queries = search.Queries([(rows[n][0], search.np.array(sorted(map(search.term, set(counted[n]))), search.np.uint64).tobytes()) for n in asked])
    found = search.np.zeros(len(queries.vocabulary))
    for part in parts:
        held, at = queries.known(search.np.frombuffer(part["terms"], search.np.uint64))
        found[at[held]] += search.np.frombuffer(part["counts"], search.np.int32)[held]
    queries.weigh(found, len(rows), sum(len(w) for _, w in rows))
    return parts, queries


@pytest.mark.parametrize("change", [{}, {"ASKED": 7, "CHUNK": 128, "NEAR": 0.0}, {"ASKED": 50, "CHUNK": 192, "COLUMNS": 8, "NEAR": 1e9}, {"CHUNK": 64, "COLUMN": 1.0, "DENSE": 0.0}])
def test_many_queries_at_once(monkeypatch, change):
    """Each query finds what it finds alone, whatever is a column, and as floors rise from shard to shard; copies go by id."""
    for k, v in change.items():
        monkeypatch.setattr(search, k, v)
    rows = languages(8, 600)
    rows += [(90_000 - i, rows[3][1]) for i in range(40)]
    parts, queries = indexed(rows, range(0, len(rows), 5), 300)
    assert len(queries.floors) < len(queries.ids)  # the copies that ask are one set
    floors, top, got = search.np.zeros(len(queries.floors)), search.np.zeros((len(queries.floors), 10)), {}
    for part in parts:
        for n, s, i in zip(*search.Shard([part], queries, 10).answers(queries.at, queries.terms, 10, floors, top)):
            got.setdefault(int(n), []).append((-round(float(s), 8), int(i)))
    whole = search.Shard(parts, queries)
    for n in range(len(queries.ids)):
        scores, ids = whole.best(queries.of(n), 10)
        assert sorted(got[int(queries.set_of[n])])[:10] == [(-round(float(s), 8), int(i)) for s, i in zip(scores, ids)]


def test_floors_rise_from_shard_to_shard(spark, monkeypatch):
    """Before, each shard of a task gave k rows for each query, so that a result grew with the square of the documents."""
    monkeypatch.setattr(search, "SHARD_WORDS", 1)
    rows = languages(2, 800)
    parts, queries = indexed(rows, range(100), 50)
    segments = spark.createDataFrame([p | {"query_id": None} for p in parts], search.INDEX).coalesce(1)
    shared = spark.sparkContext.broadcast(queries)
    found = search._run(segments, shared, 5).collect()
    assert len(found) < 0.5 * 5 * len(parts) * len(queries.ids)
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((-round(r.score, 8), r.doc_id))
    whole = search.Shard(parts, queries)
    for n, i in enumerate(queries.ids):
        assert sorted(got[i])[:5] == [(-round(float(s), 8), int(d)) for s, d in zip(*whole.best(queries.of(n), 5))]


def test_documents_without_queries(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b c"), (10, None)], "doc_id long, text string")
    assert search.search(df, F.col("doc_id") % 10 == 0).collect() == []
