import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

from tidemark.llm import queries, resampling

SCHEMA = "doc_id long, text string, bucket string, score int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, longest=2):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, buckets=10_000, percent=25, least=20, seed=7, longest=2):
    hashed = lambda t: [zlib.crc32(f.encode()) % buckets for f in features(t, longest)]
    totals = [[0] * buckets, [0] * buckets]
    for total, rows in zip(totals, (docs, target), strict=True):
        for _, text in rows:
            for b in hashed(text):
                total[b] += 1
    s, t = (sum(x) for x in totals)
    gain = [math.floor(1000 * math.log((b + 1) * (s + buckets) / ((a + 1) * (t + buckets)))) for a, b in zip(*totals, strict=True)]
    out = []
    for doc, text in docs:
        f = hashed(text)
        weight = math.floor(Fraction(sum(gain[b] for b in f), len(f))) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = order[: percent * len(order) // 100]
    return ordered((str(r[0]), *r[1:4], next((i + 1 for i, d in enumerate(drawn) if d is r), None)) for r in out)


def table(rng, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "ΑΒ", "x" * 300]
    return [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 19, 20, 21, 60])))) for i in range(n)]


def run(spark, docs, target, **options):
    d = spark.createDataFrame([(*r, "b", 1) for r in docs], SCHEMA).repartition(3)
    t = spark.createDataFrame([(*r, "b", 1) for r in target], SCHEMA)
    return ordered((str(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in resampling.resample(d, t, **options).collect())


def ordered(rows):
    return sorted(rows, key=lambda r: (*r[:4], r[4] or 0))


def test_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    docs, target = table(rng, 160), table(rng, 12)
    odd = [(900, None), (901, ""), (902, " .,! \n"), (None, docs[3][1]), (903, "SAME same Same " * 9), (904, "Same SAME same " * 9), (905, "long Words " * 30_000)]
    docs += [*odd, docs[5], docs[5]]
    want = brute(docs, target)
    assert run(spark, docs, target) == want and sum(r[4] is not None for r in want) > 15
    monkeypatch.setattr(resampling, "TRIE_WORDS", 7)  # tries given up often change nothing
    assert run(spark, docs, target) == want
    assert run(spark, docs, target, buckets=97, longest=3, percent=60, least_words=5, seed=1) == brute(docs, target, 97, 60, 5, 1, 3)


def test_empty_tables_and_ties(spark):
    assert run(spark, [], []) == [] and run(spark, [], [(1, "a b")]) == []
    docs = [(4, "a " * 20)] * 8
    out = run(spark, docs, [])
    assert [r[4] for r in out].count(None) == 6 and {r[4] for r in out} == {None, 1, 2} and out == brute(docs, [])


def test_query_reads_the_tables(spark, tmp_path):
    rng = random.Random(5)
    docs, target = table(rng, 40), table(rng, 5)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(target, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = queries.op13_resample(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert ordered((str(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()) == brute(docs, target)


def test_a_run_continues_the_state_of_its_prefix():
    long = b"y" * 200  # beyond the tables of states
    texts = [[b"a", b"bc", b"a", b"bc"], [], [b"bc"], [b"a", long, b"bc"]]
    levels = [*resampling.Trie(texts).levels(3)]
    for n, level in enumerate(levels, 1):
        runs = [(i, b" ".join(t[j : j + n])) for i, t in enumerate(texts) for j in range(len(t) - n + 1)]
        assert [(t, int(level.states[a])) for t, a in zip(level.text.tolist(), level.at.tolist(), strict=True)] == [(i, zlib.crc32(r)) for i, r in runs]
        assert sorted(level.counts.tolist()) == sorted(Counter(r for _, r in runs).values())
    assert [len(x.states) for x in levels] == [3, 4, 3]
