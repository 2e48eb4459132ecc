import random

from tests.llm import test_decontaminate, test_jaccard, test_langid, test_mixing

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n int, language string"


def documents():
    rng = random.Random(4)
    vocabulary = {k: v + [w + e for w in v for e in ("s", "en", "ado")] for k, v in test_langid.WORDS.items()}
    texts = [(lang, [rng.choice(vocabulary[lang]) for _ in range(rng.randint(8, 120))]) for lang in "aa aa bb cc".split() for _ in range(40)]
    out = [(lang, " ".join(w)) for lang, w in texts]
    for lang, w in texts[::5]:  # near and exact copies
        near = list(w)
        near[len(w) // 2] = "changed"
        out += [(lang, " ".join(near)), (lang, " ".join(w)), (lang, " ".join(w))]
    out += [("aa", None), ("bb", ""), ("cc", "12 34 !!"), (None, " ".join(texts[0][1]) + " and " + ITEM + " then")]
    return [(i * 7 % 997, t, lang, ["a", "b", None][i % 3], len(t or ""), "x", i, "y") for i, (lang, t) in enumerate(out)]


ITEM = "which of these ten words stand in exactly this one order here"


def test_every_stage_against_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "not there " * 8)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.cut(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs.collect()
        if name != "shards":
            assert docs.schema == before.schema
    plain = {r[0]: r for r in rows}
    # language: exactly the texts without letters go
    assert sorted(r.doc_id for r in kept["language"]) == sorted(r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    # near copies: the smallest id of each component stays
    ids = {c for _, _, c in test_jaccard.brute([(r.doc_id, r.text) for r in kept["language"]], 5, 80)}
    assert sorted(r.doc_id for r in kept["near_copies"]) == sorted(ids)
    assert all(tuple(r) == plain[r.doc_id] for r in kept["near_copies"])
    dirty = {r[0] for r in test_decontaminate.brute([(r.doc_id, r.text) for r in kept["near_copies"]], [(1, ITEM), (2, "not there " * 8)]) if r[5]}
    assert sorted(r.doc_id for r in kept["benchmarks"]) == sorted(ids - dirty) and dirty
    # mixture: whole rows, at most twice, words near the targets
    data = [tuple(r) for r in kept["benchmarks"]]
    _, target = test_mixing.brute_targets([(r[0], r[1], r[3]) for r in data])
    words = {}
    for r in kept["mixture"]:
        assert tuple(r) == plain[r.doc_id]
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert max(sum(r.doc_id == i for r in kept["mixture"]) for i in plain) <= 2
    assert all(abs(words[s] - t) <= 140 for s, t in target.items())
    assert sorted(r.doc_id for r in kept["shards"]) == sorted(r.doc_id for r in kept["mixture"])
    assert corpus_pipeline.run(spark, str(tmp_path)).orderBy("shard", "slot").collect() == sorted(kept["shards"], key=lambda r: (r.shard, r.slot))


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
