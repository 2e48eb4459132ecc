"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards; each node weighs as much as the shards below it. A row descends from the root:
at each level every child draws ``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's path, and the
smallest draw takes the row. A child's draw depends on its own path and weight alone, so a change of weights moves rows
only between the subtrees whose weights changed, and a subtree whose weight grew only gains rows. ``grow`` adds a shard
as a region of its own; all old weights stay, so the new shard is the only place to which rows move.

Null keys share the key of an empty text. Rows with equal keys always meet in one shard. Empty input gives an empty
result. Only the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Slots are numbered within this many parts of a shard.
SLOT_PARTS = 4096
#: Hexadecimal digits of an MD5 that make a draw: 52 bits.
DRAW_DIGITS = 13


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    slot: int
    number: int
    weight: float = 1.0


def balanced_tree(shards: int, racks_per_region: int = 3, shards_per_rack: int = 4) -> list[Shard]:
    """Shards 0 to shards - 1 filled rack by rack and region by region."""
    per_region = racks_per_region * shards_per_rack
    return [Shard(i // per_region, i % per_region // shards_per_rack, i % shards_per_rack, i) for i in range(shards)]


def grow(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, as a region of its own."""
    return [*tree, Shard(1 + max((s.region for s in tree), default=-1), 0, 0, 1 + max((s.number for s in tree), default=-1), weight)]


def _nodes(tree: list[Shard]) -> dict[str, float]:
    """Weight of each node by its path; a parent weighs what its shards weigh."""
    weights: dict[str, float] = {}
    for s in tree:
        for path in (f"{s.region}", f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.slot}"):
            weights[path] = weights.get(path, 0.0) + s.weight
    return weights


def _draw(key: Column, path: Column, weight: Column) -> Column:
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", key, path)), 1, DRAW_DIGITS), 16, 10).cast("double")
    return -F.log((digits + 1.0) / float(16**DRAW_DIGITS + 1)) / weight


def shard_column(key: Column, tree: list[Shard]) -> Column:
    """The shard number of a key. The tree is a literal map from each node to its children, so that the expression stays as
    small as the path and only the children on it draw; the first child wins a tie."""
    weights = _nodes(tree)
    children: dict[str, list[str]] = {}
    for path in sorted(weights, key=lambda p: [int(x) for x in p.split("/")]):
        children.setdefault(path.rpartition("/")[0], []).append(path)
    child = lambda i, p: F.struct(F.lit(i).alias("i"), F.lit(p).alias("path"), F.lit(weights[p]).alias("weight"))
    below = F.create_map(*[x for p, own in children.items() for x in (F.lit(p), F.array(*[child(i, c) for i, c in enumerate(own)]))])
    numbers = F.create_map(*[x for s in tree for x in (F.lit(f"{s.region}/{s.rack}/{s.slot}"), F.lit(s.number))])
    at = F.lit("")
    for _ in range(3):
        drawn = F.transform(F.element_at(below, at), lambda c: F.struct(_draw(key, c["path"], c["weight"]).alias("d"), c["i"].alias("i"), c["path"].alias("path")))
        at = F.array_min(drawn)["path"]
    return F.element_at(numbers, at).cast("int")


def shard(docs: DataFrame, tree: list[Shard], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, shard, slot, grown_shard``.

    ``size``: UTF-8 bytes of the text plus 8; a null text has no bytes and the checksum of an empty one. ``slot``: from 0
    without gaps in each shard, ordered by (part, key, checksum), where a row's part is hashed from key and checksum.
    Repeated rows get slots of their own. Slots are counted in two steps, so that no task holds a shard: rows within
    (shard, part), and parts' offsets from their counts, of which there are at most shards x SLOT_PARTS.
    """
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    crc = F.coalesce(F.crc32(F.encode(F.col(text), "utf-8")), F.lit(0)).cast("long")
    placed = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long").alias("size"),
        crc.alias("text_crc32"),
        shard_column(k, tree).alias("shard"),
        shard_column(k, grow(tree)).alias("grown_shard"),
    ).withColumn("part", F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"))), 1, 3), 16, 10).cast("int") % SLOT_PARTS)
    placed = cut(placed, "placed")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    bases = counts.select("shard", "part", before.alias("base"))
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32"))
    return placed.join(bases, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + place - 1).alias("slot"), "grown_shard")
