import random

import zstandard
from pyspark.sql import functions as F

from tidemark.llm import langid, queries

WORDS = {"aa": "the quick brown fox jumps over lazy dogs and then sleeps under trees while birds sing".split(), "bb": "der schnelle braune fuchs springt über den faulen hund und schläft dann unter großen bäumen".split(), "cc": "el rápido zorro marrón salta sobre perro perezoso mañana por las tardes duerme bajo árboles".split()}


def sample(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def rows():
    rng = random.Random(7)
    return [(i, sample(rng, lang, rng.randint(5, 200)), lang, "src", i) for i in range(240) for lang in [rng.choice("aa aa bb cc".split())]]


SCHEMA = "doc_id long, text string, lang string, source string, language int"


def test_held_out_accuracy_and_edges(spark, tmp_path):
    odd = [(1000, None, "aa", None, 1), (1001, "", "aa", None, 1), (1002, "123 --- !!", "bb", None, 1), (None, sample(random.Random(1), "bb", 60), None, None, 1), (1003, "DER SCHNELLE!!! BRAUNE 123 FUCHS SPRINGT", None, None, 1), (1004, sample(random.Random(2), "cc", 60_000), None, None, 1)]
    df = spark.createDataFrame(rows() + rows()[:5] + odd, SCHEMA).repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op2_language(spark, str(tmp_path)).collect()
    assert len(out) == 240 + 5 + len(odd)
    truth = {r[0]: r[2] for r in rows()}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (1000, 1001, 1002))
    assert by[None].lang_pred == "bb" and not by[None].held_out
    assert by[1003].lang_pred == "bb" and by[1004].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in out)
    assert not any(r.rejected for r in out if r.doc_id in truth)


def test_held_out_rows_and_ids_teach_nothing(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    changed = df.withColumn("lang", F.when(queries.held_out(), F.lit("zz")).otherwise(F.col("lang"))).withColumn("text", F.when(queries.held_out(), F.lit("zzz")).otherwise(F.col("text"))).withColumn("source", F.lit("other"))
    assert queries.learn_language(df) == queries.learn_language(changed.repartition(5))


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    (row,) = langid.identify(df, langid.learn(df)).collect()
    assert row.language.lang == "und" and row.language.rejected
    assert langid.identify(df.limit(0), langid.learn(df)).collect() == []


def test_copies_do_not_crowd_the_sample(spark):
    df = spark.createDataFrame(rows() + [(i, "copy of one text", "aa", "s", 1) for i in range(2000, 5000)], SCHEMA)
    names = [n for n, _ in langid.learn(df).dictionaries]
    assert set(names) == {"aa", "bb", "cc"} and names[0] == "aa"


def test_copies_leave_the_sample_as_it_is(spark):
    """However many copies a language has, its dictionary is that of its distinct texts."""
    rng = random.Random(3)
    texts = spark.createDataFrame([(sample(rng, "aa", 20), "aa") for _ in range(400)] + [(sample(rng, "bb", 20), "bb") for _ in range(50)], "text string, lang string")
    copies = lambda n: spark.range(n).select(F.lit("copy of one text").alias("text"), F.lit("aa").alias("lang"))
    once, often = (dict(langid.learn(texts.union(copies(n))).dictionaries) for n in (1, 500_000))
    assert len(once["aa"]) > 20_000 and often == once


def test_numerals_are_no_letters():
    classify = langid.Classifier(langid.Model((("aa", b"the quick brown fox " * 20),)))
    assert [classify(t)[0] for t in ("\u00b2 \u00bd \u2460", "\u2167 12_3", "a", "\u00e9 5", "\u4e2d")] == ["und", "und", "aa", "aa", "aa"]


def test_sizes_against_compression_of_whole_blocks(spark):
    """The smallest of plainly compressed blocks decides, dictionary by dictionary."""
    df = spark.createDataFrame(rows(), SCHEMA)
    model = langid.learn(df)
    classify = langid.Classifier(model)
    for _, text, *_ in rows()[:60]:
        long = " ".join([text] * 12)
        data = " ".join("".join(c if c.isalpha() else " " for c in long.lower()).split()).encode()
        assert langid.normalized(long).split() == data.split()
        sizes = []
        for _, own in model.dictionaries:
            packer = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            sizes.append(sum(len(packer.compress(data[i : i + langid.BLOCK_BYTES])) for i in range(0, len(data), langid.BLOCK_BYTES)))
        assert classify(long)[0] == model.dictionaries[min(range(len(sizes)), key=sizes.__getitem__)][0]


def test_labels_with_hardly_a_letter_are_learned(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("abc", "tiny"), ("123 --", "none"), *[("the quick brown fox jumps over the lazy dog " * 5, "aa")] * 4])]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [name for name, _ in model.dictionaries] == ["aa", "none", "tiny"] and all(len(d) >= 8 for _, d in model.dictionaries)
    assert len(langid.Classifier(model).sizes(b"abc abc")) == 3  # each label takes part in every decision
    assert langid.Classifier(model)("the lazy fox jumps over the brown dog")[0] == "aa"
