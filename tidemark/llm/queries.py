"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, langid, licenses, lmscore, mixing, resampling, search, secrets, sharding, urlfilter, vectorcodes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"))
    records = warc.read(archives)
    return records.select(
        F.expr(r"try_cast(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.expr(r"try_cast(regexp_extract(refers_to, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)").alias("refers_to"),
        "problem",
    )


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
     f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM f"""


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 by 3. Null ids are not held out."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def learn_language(docs: DataFrame) -> langid.Model:
    return langid.learn(docs, F.col("doc_id").isNotNull() & ~held_out())


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = langid.identify(docs.select("doc_id", "text"), learn_language(docs))
    return said.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), n=4, percent=85)


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row_id, doc_id,
            coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
     s AS (SELECT row_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i : i + 3], ' '))) END AS grams FROM d),
     g AS (SELECT row_id, unnest(grams) AS gram FROM s),
     o AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.row_id < b.row_id GROUP BY ALL),
     l AS (SELECT a, b FROM o JOIN s x ON x.row_id = a JOIN s y ON y.row_id = b WHERE 100 * n >= 85 * (len(x.grams) + len(y.grams) - n)),
     e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     reach AS (SELECT a AS origin, a AS node FROM e UNION SELECT origin, e.b FROM reach JOIN e ON e.a = node)
SELECT d.doc_id, len(s.grams) AS n_shingles, coalesce(min(m.doc_id), d.doc_id) AS component_id
FROM d JOIN s USING (row_id) LEFT JOIN reach r ON r.origin = d.row_id LEFT JOIN d m ON m.row_id = r.node
GROUP BY d.row_id, d.doc_id, len(s.grams)"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


#: Words of alphanumerics of a column, as a list, in DuckDB.
ALNUM_SQL = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce({ALNUM_SQL.format("text")}, []) AS w FROM documents),
     b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {ALNUM_SQL.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
     bw AS (SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS words
            FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT size FROM bw),
     dw AS (SELECT row_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS words
            FROM (SELECT row_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
     hits AS (SELECT row_id, size, i, item FROM dw JOIN bw USING (size, words)),
     n AS (SELECT row_id, count(DISTINCT place) AS n_hit FROM (SELECT row_id, unnest(generate_series(i, i + size - 1)) AS place FROM hits) GROUP BY row_id),
     its AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_id, item FROM hits) GROUP BY row_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (row_id) LEFT JOIN its USING (row_id)"""


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 100 == 0, k=10)


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {ALNUM_SQL.format("text")} AS w FROM documents WHERE text IS NOT NULL),
     n AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d WHERE len(w) > 0),
     tf AS (SELECT row_id, doc_id, len(w) AS length, term, count(*) AS n FROM (SELECT row_id, doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
     df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
     q AS (SELECT DISTINCT doc_id AS query_id, term FROM tf WHERE doc_id % 100 = 0),
     s AS (SELECT q.query_id, tf.row_id, tf.doc_id,
                  round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean)) ORDER BY q.term), 9) AS score
           FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY q.query_id, tf.row_id, tf.doc_id)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s) WHERE rank <= 10"""


#: Rules of op9: host and path, verdict.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules).drop("url")


OP9_SQL = """
WITH r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
     u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path,
       (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS rule,
       coalesce((SELECT arg_max(r.verdict, length(r.host || r.path)) FROM r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)), 'allow') AS verdict
FROM p"""


#: Shards of op10: 2 regions of 3 racks of 4 shards.
SHARDS = 24


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), sharding.balanced_tree(SHARDS))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def _rounds_sql(rounds: int) -> str:
    """CTEs a0, c1, a1, ...: the nearest entry of each part, and the codebooks after each round."""
    out = []
    for i in range(rounds + 1):
        if i:
            out.append(f"""
     s{i} AS (SELECT a.part, a.entry, u.place, CAST(floor(sum(p.v[u.place]) / count(*)) AS DOUBLE) AS x
             FROM a{i - 1} a JOIN p USING (vec_id, part), LATERAL (SELECT unnest(generate_series(1, len(p.v))) AS place) u GROUP BY ALL),
     m{i} AS (SELECT part, entry, list(x ORDER BY place) AS e FROM s{i} GROUP BY ALL),
     c{i} AS MATERIALIZED (SELECT part, entry, coalesce(m.e, c.e) AS e FROM c{i - 1} c LEFT JOIN m{i} m USING (part, entry))""")
        out.append(f"""
     a{i} AS MATERIALIZED (SELECT vec_id, part, best.d AS d, best.entry AS entry FROM (
             SELECT p.vec_id, p.part, min({{'d': list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, c.e) + list_dot_product(c.e, c.e), 'entry': c.entry}}) AS best
             FROM p JOIN c{i} c USING (part) GROUP BY ALL))""")
    return ",".join(out)


OP11_SQL = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     p AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS v FROM k, range(4) AS t(part)),
     f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 256),
     c0 AS MATERIALIZED (SELECT part, entry, v AS e FROM p JOIN f USING (vec_id)),{_rounds_sql(4)},
     r AS (SELECT vec_id, string_agg(lpad(lower(to_hex(CAST(entry AS BIGINT))), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id),
     h AS (SELECT sha256(string_agg(array_to_string(list_transform(e, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN k USING (vec_id), h"""


def scored_apart(doc_id: str = "doc_id"):
    """Whether a document is kept from the language model: crc32 of its id as text leaves 1 by 5."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 5 == 1


def op12_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), scored_apart()).drop("n_bytes")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # imports this subpackage

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_language": op2_language,
        "op3_licenses": op3_licenses,
        "op4_jaccard": op4_jaccard,
        "op5_mixing": op5_mixing,
        "op6_secrets": op6_secrets,
        "op7_decontaminate": op7_decontaminate,
        "op8_search": op8_search,
        "op9_urlfilter": op9_urlfilter,
        "op10_sharding": op10_sharding,
        "op11_codes": op11_codes,
        "op12_lmscore": op12_lmscore,
        "op13_resample": op13_resample,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op4_jaccard": OP4_SQL, "op7_decontaminate": OP7_SQL, "op8_search": OP8_SQL, "op9_urlfilter": OP9_SQL, "op11_codes": OP11_SQL}
