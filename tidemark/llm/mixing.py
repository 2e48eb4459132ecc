"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Every document starts with rate 1. Rates between 0 and CAP of least entropy relative to that, under one token constraint for
each source (the rates times the sizes sum to the source's target), are ``CAP / (1 + (CAP - 1) exp(-lambda z))`` with z a
document's size over its source's mean size; CAP is 2. The dual is convex in one lambda a source, and Newton steps
solve it for all sources at once, each step one pass over the counts of documents by (source, size). A step that leaves
the bracket found so far halves it instead. Sums are of decimals, so that reruns agree whatever the partitions.

Rates become copies by systematic rounding: within a source, by rising size, a document takes one more copy where the running
sum of fractions passes a whole number. Neighbours in that order have like sizes, so a source's words miss its target by
little more than one of its longest documents.

Null sources are a source of their own, the last; null texts have size 0 and null ids take part like others. Documents of
size 0 have rate 1. Repeated rows are documents of their own. An empty table gives an empty result. Only the named columns
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, space_words

#: Weights of sources by code point, repeating; null last.
WEIGHTS = (5, 2, 1)
#: What all targets together are of all sizes, and a target of its source's size at most.
SHARE, CAP = 1.5, 2
#: Newton steps at most, and the relative error of every source's words at which they end.
STEPS, TOLERANCE = 60, 1e-9
#: lambda's bracket; sizes are over their source's mean.
BRACKET = 4096.0
#: Fractions of copies are in units of 1 / ONE.
ONE = 1 << 24
#: Rows of a (source, size) are dealt over so many parts for ranking, and more where the table has more rows than PART_ROWS a part.
PARTS, PART_ROWS = 32, 1 << 20


def targets(sources: DataFrame) -> DataFrame:
    """``source, docs, source_size`` with ``target``: total * SHARE by weight, none above CAP * source_size, the excess
    reshared by weight among the others until none is above.

    The multiplier of the weights rises with each round, which fixes the sources that it fills; it ends when a round fills no
    more, and needs at most as many rounds as there are sources. One row of sums comes to the driver in each.
    """
    n = len(WEIGHTS)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % n + 1).cast("int"))
    weighted = sources.withColumn("weight", weight).withColumn("most", F.lit(float(CAP)) * F.col("source_size"))
    total = (weighted.agg(F.sum("source_size")).first()[0] or 0) * SHARE
    level, filled = 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("most")
        row = weighted.agg(
            F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count_if(full).alias("filled"),
        ).first()
        if row["filled"] == filled or not row["weight"]:
            break
        filled = row["filled"]
        level = (total - row["taken"]) / row["weight"]
    return weighted.withColumn("target", F.least(F.col("most"), F.col("weight") * level)).drop("weight", "most")


def rate(tilt: Column, z: Column) -> Column:
    """Rate of a document; CAP where the source's target is all that it can give (tilt null)."""
    return F.when(tilt.isNull(), F.lit(float(CAP))).otherwise(F.lit(float(CAP)) / (F.lit(1.0) + F.lit(CAP - 1.0) * F.exp(-tilt * z)))


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,12)")


def tilts(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with ``tilt``, from ``source, size, n`` of cells, by safeguarded Newton steps on the dual."""
    filled = F.col("target") >= CAP * F.col("source_size")
    state = sources.withColumns({"mean": F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)), "tilt": F.when(~filled, F.lit(0.0)), "low": F.lit(-BRACKET), "high": F.lit(BRACKET)})
    for _ in range(STEPS):
        z = F.col("size") / F.col("mean")
        r = rate(F.col("tilt"), z)
        joined = cells.join(state.select(F.col("source").alias("s"), "tilt", "mean"), F.col("source").eqNullSafe(F.col("s"))).where("tilt is not null")
        moments = joined.groupBy("s").agg(
            F.sum(_exact(F.col("n") * F.col("size") * r)).cast("double").alias("got"),
            F.sum(_exact(F.col("n") * F.col("size") * z * r * (F.lit(1.0) - r / CAP))).cast("double").alias("slope"),
        )
        off = F.coalesce(F.col("got") - F.col("target"), F.lit(0.0))
        low = F.when(off < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(off, F.col("slope"))
        inside = F.coalesce((newton > low) & (newton < high), F.lit(False))
        state = cut(
            state.join(moments, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source", "docs", "source_size", "target", "mean",
                F.when(off == 0, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2).alias("tilt"),
                low.alias("low"), high.alias("high"), (F.abs(off) / F.greatest(F.col("target"), F.lit(1.0))).alias("error"),
            ),
            "tilts",
        )
        if (state.agg(F.max("error")).first()[0] or 0.0) <= TOLERANCE:
            break
        state = state.drop("error")
    return state


def sized(docs: DataFrame, doc_id: str, text: str, source: str, *more: Column) -> DataFrame:
    """``doc_id, source, size, h`` and more columns; h orders documents of one source and size."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), space_words(F.col(text)).alias("size"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"), *more)


def rates(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rates by (source, size, part) of sized() rows, with what the rounding needs; the number of parts."""
    parts = max(PARTS, -(-rows.count() // PART_ROWS))
    by_part = cut(rows.groupBy("source", "size", _part(parts).alias("part")).agg(F.count("*").alias("n")), "cells")
    cells = by_part.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = cut(cells.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("source_size")), "sources")
    solved = tilts(cells, cut(targets(sources), "targets")).select(F.col("source").alias("s"), "source_size", "target", "mean", "tilt")
    rated = by_part.join(solved, F.col("source").eqNullSafe(F.col("s")))
    rated = rated.withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(rate(F.col("tilt"), F.col("size") / F.col("mean"))))
    rated = rated.withColumn("whole", F.floor("rate")).withColumn("fraction", F.round((F.col("rate") - F.floor("rate")) * ONE).cast("long"))
    # the running sum of fractions before each part; half a unit at the start centres the error
    before = F.sum(F.col("n") * F.col("fraction")).over(Window.partitionBy("source").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1))
    based = rated.withColumn("base", F.coalesce(before, F.lit(0)) + ONE // 2)
    return based.select(F.col("s").alias("cell_source"), F.col("size").alias("cell_size"), F.col("part").alias("cell_part"), "source_size", "target", "rate", "whole", "fraction", "base"), parts


def _part(parts: int) -> Column:
    return F.pmod(F.col("h"), F.lit(parts)).cast("int")


def with_copies(rows: DataFrame, rated: DataFrame, parts: int) -> DataFrame:
    """sized() rows with the columns of their cell and ``copies``; a cell's documents are ranked within its parts."""
    dealt = rows.withColumn("part", _part(parts))
    same_cell = F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("size") == F.col("cell_size")) & (F.col("part") == F.col("cell_part"))
    ranked = dealt.join(rated, same_cell).withColumn("place", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "doc_id")))
    upto = lambda k: F.floor((F.col("base") + k * F.col("fraction")) / F.lit(ONE))
    return ranked.withColumn("copies", (F.col("whole") + upto(F.col("place")) - upto(F.col("place") - 1)).cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Per row: ``doc_id, size, source_size, target, rate, copies, taken``. copies are 0, 1 or 2, taken = copies * size."""
    rows = cut(sized(docs, doc_id, text, source), "sized")
    return with_copies(rows, *rates(rows)).select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them."""
    rated = rates(cut(sized(docs, doc_id, text, source), "sized"))
    taken = with_copies(sized(docs, doc_id, text, source, F.struct("*").alias("row")), *rated).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
