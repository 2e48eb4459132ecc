"""Language identification by compression.

Each language has a zstandard raw-content dictionary cut from a bounded sample of its labelled texts. A text is lower-cased,
everything but letters becomes a space, and each of its blocks is compressed with every dictionary; the language whose
blocks are smallest in sum is the prediction, the most frequent label on ties. A text is rejected when the margin to the
second language is narrow, or when it has no letters.

Null texts and texts without letters are ``und`` with score 0 and rejected. Rows without a label or text teach nothing; with
nothing learned every text is ``und``. Repeated rows get repeated results, an empty table an empty one. Other columns may
have any names.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import frugal, slices

#: Sample: so many texts a language at most, PIECES pieces of PIECE_CHARS of each; the dictionary holds the first bytes of these.
SAMPLE_TEXTS = 256
PIECES, PIECE_CHARS = 4, 512
DICTIONARY_BYTES, LEAST_BYTES = 128 << 10, 8
#: Texts are compressed in blocks, so that the dictionary stays near the end of a long text as well.
BLOCK_BYTES = 4096
LEVEL, MIN_MATCH = 6, 3
#: Short texts follow this filler, without which zstandard would store them raw; its own size is taken off.
SHORT_BYTES, FILLER = 1024, b"0123456789" * 12
#: A smaller share of the second size between the two best is narrow.
MIN_MARGIN = 0.005
#: Margin at which the score is one half.
HALF_SCORE = 0.02
#: What is no letter by its Unicode category; numerals and marks are none.
NOT_LETTERS = regex.compile(r"[^\p{L}]+")


@dataclass(frozen=True)
class Model:
    #: Languages by falling frequency, each with its dictionary.
    dictionaries: tuple[tuple[str, bytes], ...]


def normalized(text: str) -> bytes:
    return NOT_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace")


def learn(docs: DataFrame, usable: Column | None = None, text: str = "text", lang: str = "lang") -> Model:
    """Fit on the rows where usable holds. The sample takes the texts of the smallest hashes, each text once, whichever rows
    hold it, at most SAMPLE_TEXTS for each language; counts of labels are of all rows."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = (rows if usable is None else rows.where(usable)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    h = F.xxhash64("text")
    found = rows.groupBy("lang", h.alias("h")).agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()
    counts = {r["lang"]: r["n"] for r in found}
    if not counts:
        return Model(())
    # A share of the hash range that holds SAMPLE_TEXTS; of the distinct texts, as copies share a hash, and four times as much, so that chance leaves enough.
    share = F.create_map(*[F.lit(x) for r in sorted(found) for x in (r["lang"], min(1.0, 4 * SAMPLE_TEXTS / r["texts"]))])
    picked = (
        rows.withColumn("h", h)
        .where(F.pmod("h", F.lit(1 << 40)) < F.element_at(share, F.col("lang")) * float(1 << 40))
        .withColumn("pieces", F.expr(f"array_distinct(transform(sequence(0, {PIECES - 1}), i -> substring(text, int(1 + pmod(xxhash64(text, i), greatest(length(text) - {PIECE_CHARS - 1}, 1))), {PIECE_CHARS})))"))
        .groupBy("lang", "h")
        .agg(F.first("pieces").alias("pieces"))
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h")))
        .where(F.col("place") <= SAMPLE_TEXTS)
        .orderBy("lang", "place")
        .collect()
    )
    out = []
    for name, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        texts = [r["pieces"] for r in picked if r["lang"] == name]
        turns = [p[i] for i in range(PIECES) for p in texts if i < len(p)]
        out.append((name, b"".join(normalized(p) + b" " for p in turns)[:DICTIONARY_BYTES]))
    # zstandard takes no shorter dictionary; a label whose sample has hardly a letter keeps one of spaces
    return Model(tuple((name, data.ljust(LEAST_BYTES)) for name, data in out))


class Classifier:
    def __init__(self, model: Model):
        self.names = [name for name, _ in model.dictionaries]
        self.packers = []
        for _, data in model.dictionaries:
            parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
            dictionary = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=parameters)
            self.packers.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters))
        self.filler = [len(p.compress(FILLER)) for p in self.packers]

    def sizes(self, data: bytes) -> list[int]:
        if len(data) < SHORT_BYTES:
            return [len(p.compress(FILLER + data)) - f for p, f in zip(self.packers, self.filler, strict=True)]
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(p.compress(b)) for b in blocks) for p in self.packers]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, whether it is rejected."""
        data = normalized(text) if text else b""
        if not data.strip() or not self.names:
            return "und", 0.0, True
        sizes = self.sizes(data)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = max(0.0, (second - sizes[best]) / max(1, second))
        return self.names[best], margin / (margin + HALF_SCORE), margin < MIN_MARGIN


def free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """docs with one more column, a struct (lang, score, rejected) named into."""

    @frugal
    def run(batches):
        classify = Classifier(model)
        for whole in batches:
            for batch in slices(whole):
                rows = [classify(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                fields = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                result = pa.StructArray.from_arrays(fields, ["lang", "score", "rejected"])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], result], [*batch.schema.names[:-1], into])

    # the text goes last under a name of its own, whatever the columns before it are
    schema = docs.select("*", F.struct(F.lit("").alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")).alias(into)).schema
    return docs.select("*", F.col(text).alias(free_name(docs, "text_read"))).mapInArrow(run, schema)
