"""Hash-chained ledgers: each record's hash covers the one before, so that an edited or missing record is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def short_id(*parts: Column, length: int = 16) -> Column:
    """First hexadecimal digits of the SHA-256 of the parts joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def entry_hash(previous: str, seq: int, record: str) -> str:
    import hashlib

    return hashlib.sha256(f"{previous}|{seq}|{record}".encode()).hexdigest()


def chain(events: DataFrame, key: str = "account") -> DataFrame:
    """key, seq, record with prev_hash and hash. A chain is a fold by nature; chains are independent groups."""

    def run(group):
        previous, rows = GENESIS, []
        for seq, record in group.sort_values("seq")[["seq", "record"]].itertuples(index=False, name=None):
            rows.append((previous, previous := entry_hash(previous, seq, record)))
        out = group.sort_values("seq").copy()
        out["prev_hash"], out["hash"] = zip(*rows, strict=True)
        return out[[key, "seq", "record", "prev_hash", "hash"]]

    slim = events.select(key, F.col("seq").cast("long").alias("seq"), "record")
    return slim.groupBy(key).applyInPandas(run, f"`{key}` {slim.schema[key].dataType.simpleString()}, seq long, record string, prev_hash string, hash string")


def verify(ledger: DataFrame, key: str = "account") -> DataFrame:
    """Broken records with the reason. Each record is checked against its neighbour, so a chain needs no fold to be verified."""
    w = Window.partitionBy(key).orderBy("seq")
    before, number = F.coalesce(F.lag("hash").over(w), F.lit(GENESIS)), F.lag("seq").over(w)
    own = F.sha2(F.concat_ws("|", "prev_hash", F.col("seq").cast("string"), "record"), 256)
    checked = ledger.withColumns({"__before": before, "__number": number, "__own": own})
    problem = F.when(F.col("hash") != F.col("__own"), "record differs from its hash").when(F.col("prev_hash") != F.col("__before"), "does not follow the record before").when(F.col("seq") != F.coalesce(F.col("__number") + 1, F.col("seq")), "number is missing or repeated")
    return checked.withColumn("problem", problem).where("problem is not null").select(key, "seq", "problem")


def fingerprint(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Content hash of each key's rows: rows are hashed where they are, and the hashes hashed in order."""
    each = rows.select(*keys, *order, F.sha2(F.to_json(F.struct(*order, *columns)), 256).alias("__h"))
    return each.groupBy(*keys).agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "__h"))), lambda x: x["__h"]), ""), 256).alias("fingerprint"))


def block_fingerprint(rows: DataFrame, keys: tuple[str, ...], block: str, order: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Content hash of each key's rows by blocks (a column that orders them, such as a month): the texts of a row are hashed, a block's hashes in order, and the blocks' in theirs, so that no array
    holds more than a block's rows or a key's blocks. Columns are texts."""
    each = rows.select(*keys, block, *order, F.sha2(F.concat_ws("|", *order, *columns), 256).alias("__h"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(c), lambda x: x["__h"]), ""), 256)
    blocks = each.groupBy(*keys, block).agg(F.count("*").alias("n"), joined(F.collect_list(F.struct(*order, "__h"))).alias("__h"))
    return blocks.groupBy(*keys).agg(F.sum("n").alias("rows"), joined(F.collect_list(F.struct(block, "__h"))).alias("fingerprint"))
