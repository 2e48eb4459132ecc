"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A rule lists ``host + path`` with a verdict; it fits its host and all subdomains when the URL's path starts with the
rule's path, and the longest fitting rule decides (``block`` before ``allow`` on ties). A URL's possible keys are its host
suffixes times its path prefixes of the lengths that occur in the list. The Bloom filter is a table of 64-bit words, a key
setting BITS bits of one word; it has at most MAX_WORDS words whatever the list's size, so that it can always be
broadcast. A crowded filter passes more false positives, which the exact join on the key removes.

Null URLs, and URLs without ``://``, have an empty host and path and fit no rule. Repeated pages each get a row. Null and
slashless rules: null rules are ignored, a rule without a slash has an empty path. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits that a key sets in its word.
BITS = 6
#: Words of the filter at most: 8 MB of bits.
MAX_WORDS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical_rules(rules: DataFrame) -> DataFrame:
    """``rule, verdict`` as ``key_host, key_path, rule, verdict``, one row for each key."""
    cut_at = F.instr("rule", "/")
    host = F.when(cut_at > 0, F.substr("rule", F.lit(1), cut_at - 1)).otherwise(F.col("rule"))
    path = F.when(cut_at > 0, F.substr("rule", cut_at)).otherwise("")
    return (
        rules.where("rule is not null and verdict is not null")
        .select(F.translate(host, UPPER, LOWER).alias("key_host"), path.alias("key_path"), "verdict")
        .groupBy("key_host", "key_path")
        .agg(F.max("verdict").alias("verdict"))  # block after allow
        .withColumn("rule", F.concat("key_host", "key_path"))
    )


def _word(host: Column, path: Column, words: int) -> tuple[Column, Column]:
    """Which word a key belongs to and which of its bits it sets."""
    h = F.xxhash64(host, path)
    g = F.xxhash64(path, host, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(h, F.lit(words)).cast("int"), mask


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: ``page_id, url, host, path, rule, verdict``; no fitting rule: rule null and the default verdict.

    The final join has URLs as keys; a URL that holds many rows is split there by adaptive skew handling, and all steps
    before it see each distinct (URL, key) that passed the filter once.
    """
    listed = canonical_rules(rules)
    shape = listed.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("key_host", r"\."))).alias("labels"),
        F.collect_set(F.length("key_path")).alias("lengths"),
    ).first()
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    if not shape["n"]:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    words = min(MAX_WORDS, max(64, 1 << (shape["n"] // 4).bit_length()))
    at, mask = _word(F.col("key_host"), F.col("key_path"), words)
    bloom = listed.select(at.alias("at"), mask.alias("mask")).groupBy("at").agg(F.bit_or("mask").alias("bits"))

    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(shape["labels"]))),
        lambda n: F.array_join(F.slice(labels, -n, n), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in sorted(shape["lengths"])]), lambda n: n <= F.length("path")),
        lambda n: F.substr("path", F.lit(1), n),
    )
    keys = (
        rows.where(F.col("host") != "")
        .select("url", suffixes.alias("suffixes"), prefixes.alias("prefixes"))
        .select("url", F.explode("suffixes").alias("key_host"), "prefixes")
        .select("url", "key_host", F.explode("prefixes").alias("key_path"))
    )
    at, mask = _word(F.col("key_host"), F.col("key_path"), words)
    possible = (
        keys.withColumns({"at": at, "mask": mask})
        .join(F.broadcast(bloom), "at")  # at most MAX_WORDS rows
        .where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        .select("url", "key_host", "key_path")
        .distinct()
    )
    best = (
        possible.join(listed, ["key_host", "key_path"])
        .groupBy("url")
        .agg(F.max(F.struct(F.length("rule").alias("long"), F.length("key_host").alias("host_long"), "rule", "verdict")).alias("best"))
        .select("url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return rows.join(best, "url", "left").select("page_id", "url", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
