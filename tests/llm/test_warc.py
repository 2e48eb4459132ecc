import gzip
import hashlib
import io

from tidemark.llm import queries, warc

BIG = "é" * 60


def rows():
    return [
        (1, "http://a/?x y\r\nz", "short"), (2, None, "short"), (5, "u", BIG), (3, "u", BIG), (4, "u", BIG), (4, "u", BIG), (None, "u", BIG),
        (6, "u", None), (7, "u", ""), (None, "u", "only" * 40), (8, "u", "x" * 99), (9, "u", "x" * 99), (10, "u", "y" * 100), (11, "u", "y" * 100), (12, "u", "long " * 200_000),
    ]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, "extra") for r in rows()], "page_id long, url string, html string, digest string").repartition(3)
    manifest = warc.write(df)
    assert manifest.groupBy().sum("records").first()[0] == len(rows())
    got = [(r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in warc.read(manifest, payload=True).collect() if r.problem is None]
    want = []
    first = {}
    for i, _, html in rows():
        body = (html or "").encode()
        if i is not None and len(body) >= 100:
            first[body] = min(i, first.get(body, i))
    for i, _, html in rows():
        body = (html or "").encode()
        refers = first.get(body)
        revisit = refers is not None and refers != i
        want.append((f"<urn:page:{'none' if i is None else i}>", "revisit" if revisit else "response", f"<urn:page:{refers}>" if revisit else None, len(body), hashlib.sha256(body).hexdigest(), None if revisit else body))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_query_returns_ids(spark, tmp_path):
    spark.createDataFrame(rows(), "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.op1_warc(spark, str(tmp_path)).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in out} >= {(3, "response", None), (5, "revisit", 3), (11, "revisit", 10), (6, "response", None), (9, "response", None), (None, "revisit", 3)}


def test_damage_is_reported():
    body = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "d")
    good = gzip.compress(body)
    assert [r["problem"] for r in warc.members(io.BytesIO(good + good), "a")] == [None, None]
    assert [r["problem"] for r in warc.members(io.BytesIO(good + good[:-20]), "a")] == [None, "member ends early"]
    assert [r["problem"] for r in warc.members(io.BytesIO(good + b"junk"), "a")][1].startswith("gzip")
    assert [r["problem"] for r in warc.members(io.BytesIO(gzip.compress(body.replace(b"payload\r", b"paYload\r"))), "a")] == ["payload digest differs"]
    assert [r["problem"] for r in warc.members(io.BytesIO(gzip.compress(b"hello")), "a")] == ["no header"]
    assert list(warc.members(io.BytesIO(b""), "a")) == []


def test_chunks_and_offsets():
    parts = [gzip.compress(warc.record(i, "u", bytes([i]) * 700_000, "", None, "d")) for i in range(3)]
    out = list(warc.members(io.BytesIO(b"".join(parts)), "a", keep=True))
    assert [r["payload"] for r in out] == [bytes([i]) * 700_000 for i in range(3)]
    assert [r["offset"] for r in out] == [0, len(parts[0]), len(parts[0]) + len(parts[1])]


def test_empty(spark):
    manifest = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read(manifest).collect() == []
