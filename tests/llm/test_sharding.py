import hashlib
import math
import zlib

from tidemark.llm import sharding

SCHEMA = "doc_id long, text string, shard string, part string"


def brute_shard(key: str, tree) -> int:
    weights = sharding._nodes(tree)
    numbers = {f"{s.region}/{s.rack}/{s.slot}": s.number for s in tree}
    at = ""
    for depth in range(3):
        paths = sorted(p for p in weights if p.count("/") == depth and p.startswith(at))
        u = lambda p: (int(hashlib.md5(f"{key}|{p}".encode()).hexdigest()[:13], 16) + 1) / (16**13 + 1)
        best = min(paths, key=lambda p: -math.log(u(p)) / weights[p])
        at = best + "/"
    return numbers[best]


def test_rows_follow_the_tree_and_slots_are_gapless(spark):
    rows = [(i, f"text {i}", "x", "y") for i in range(400)] + [(None, None, None, None)] * 3 + [(7, "", "x", "y"), (7, "text 7", "x", "y"), (8, "é" * 50_000, "", "")]
    tree = sharding.balanced_tree(24)
    out = sharding.shard(spark.createDataFrame(rows, SCHEMA).repartition(3), tree).collect()
    assert len(out) == len(rows)
    for r in out:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.shard == brute_shard(key, tree)
        assert r.grown_shard == brute_shard(key, sharding.grow(tree))
        assert r.grown_shard in (r.shard, 24)
    assert any(r.grown_shard == 24 for r in out)
    for s in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    by = {(r.doc_id, r.text_crc32): r for r in out}
    assert by[(8, zlib.crc32(("é" * 50_000).encode()))].size == 100_008
    assert by[(None, 0)].size == 8
    assert by[(7, 0)].shard == by[(7, zlib.crc32(b"text 7"))].shard


def test_weight_change_moves_rows_only_into_the_heavier_subtree(spark):
    tree = sharding.balanced_tree(24)
    heavy = [s if (s.region, s.rack) != (1, 2) else sharding.Shard(s.region, s.rack, s.slot, s.number, 2.0) for s in tree]
    for i in range(600):
        a, b = brute_shard(str(i), tree), brute_shard(str(i), heavy)
        assert a == b or b // 12 == 1


def test_empty_table(spark):
    out = sharding.shard(spark.createDataFrame([], SCHEMA), sharding.balanced_tree(4))
    assert out.collect() == [] and out.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "grown_shard"]
