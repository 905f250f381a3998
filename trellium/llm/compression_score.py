"""Language-model score by compression: sizes of a text under an in-domain and a general dictionary.

Both dictionaries are made of the words of the corpus that save the most bytes, by counts over all
documents: the in-domain one counts documents labelled good and not toxic, the general one counts
every document.  Words are counted where they are read and meet by word; a word that occurs once in
all documents saves nothing and is in no dictionary.  A dictionary's size grows with what was counted:
`share` of the bytes of the different words, `least` at the least, and at the most `most`, the bound of
what is broadcast; zstd's tables grow with it.  Which words are in is found from sums over ranges of
savings, so no words but those of the dictionaries come to the driver.

score = (general size - in-domain size) / general size: positive where the in-domain model predicts
the text better.

Nulls: a null text has a null score and null sizes.  An empty text has the size of an empty frame
under both, and score 0.  A null doc_id has no label.  Very long texts are compressed whole, in pieces
of `piece` bytes each with the dictionary, so that all of them stay in its reach; words of over
`longest` bytes are in no dictionary.  Labels that repeat a doc_id count as good only if all are; ties
between words go by the word.  Extra columns stay; those named like the results are replaced.  An
empty table gives an empty table; without good labels both dictionaries are the general one and scores
are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared


@dataclass(frozen=True)
class Plan:
    """Production parameters."""

    share: float = 0.25
    least: int = 112_640
    #: Two dictionaries of this size are within what may be broadcast.
    most: int = 4 << 20
    piece: int = 1 << 20
    level: int = 3
    #: Bytes of the words that a dictionary takes.
    shortest: int = 4
    longest: int = 64


def good_ids(labels: DataFrame) -> DataFrame:
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").alias("label_id"))
    rows = rows.agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("good")).where("good")
    return shared.small(rows, 16)


def word_counts(docs: DataFrame, labels: DataFrame, plan: Plan, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(word, n, good): how often each word occurs in all documents and in good ones."""
    d = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    d = d.join(good_ids(labels), F.col("id") == F.col("label_id"), "left")
    words = d.select(F.explode(F.split("text", "[ \t\n\r]+")).alias("word"), F.when(F.col("good"), 1).otherwise(0).alias("g"))
    words = words.where(F.octet_length("word").between(plan.shortest, plan.longest))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.sum("g").alias("good"))


#: Ranges of savings in each factor of e.
RANGES = 64


def dictionaries(counts: DataFrame, plan: Plan) -> tuple[bytes, bytes]:
    """(in-domain, general), each of the words that save the most, the best at the end, where offsets are shortest."""
    bytes_ = F.octet_length("word") + 1

    def best(column: str) -> bytes:
        gain = F.col(column) * (F.octet_length("word") - (plan.shortest - 2))
        words = counts.where(F.col(column) > 0).select("word", gain.alias("gain"), F.floor(F.log(gain) * RANGES).cast("int").alias("range"))
        ranges = sorted(((r["range"], r["b"]) for r in words.groupBy("range").agg(F.sum(bytes_).alias("b")).collect()), reverse=True)
        limit = min(max(plan.least, int(plan.share * sum(b for _, b in ranges))), plan.most)
        left, keep = limit, F.lit(False)
        for r, b in ranges:
            if b > left:  # of the range at the border, the part that fits, by hash
                keep = keep | ((F.col("range") == r) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(left / b * (1 << 20))))
                break
            left -= b
            keep = keep | (F.col("range") == r) if r == ranges[0][0] else F.col("range") >= r
        rows = words.where(keep).select(F.col("gain").cast("bigint").alias("gain"), F.col("word").cast("binary").alias("word")).toArrow().sort_by([("gain", "descending"), ("word", "descending")])
        out, size = [], 0
        for word in rows.column("word").to_pylist():
            w = word + b" "
            if size + len(w) <= limit:
                out.append(w)
                size += len(w)
        return b"".join(reversed(out))

    general = best("n")
    return best("good") or general, general


def compressor(content: bytes, plan: Plan) -> zstandard.ZstdCompressor:
    """A compressor whose tables hold all positions of the dictionary, and whose window reaches over it and a piece of text."""
    if not content:
        return zstandard.ZstdCompressor(level=plan.level, write_content_size=False)
    bits = (len(content) + plan.piece).bit_length()
    bits = {"window_log": max(bits, 17), "hash_log": max(len(content).bit_length(), 17), "chain_log": max(len(content).bit_length() - 1, 16)}
    params = zstandard.ZstdCompressionParameters.from_level(plan.level, **bits, write_content_size=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=params)


def size_of(c: zstandard.ZstdCompressor, text: bytes, plan: Plan) -> int:
    return sum(len(c.compress(text[i : i + plan.piece])) for i in range(0, max(len(text), 1), plan.piece))


def score(docs: DataFrame, labels: DataFrame, plan: Plan = Plan(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with in_domain_bytes, general_bytes and score."""
    counts = shared.checkpoint(word_counts(docs, labels, plan, text, doc_id).where("n > 1"))
    both = docs.sparkSession.sparkContext.broadcast(dictionaries(counts, plan))
    added = [("in_domain_bytes", T.LongType()), ("general_bytes", T.LongType()), ("score", T.DoubleType())]
    kept = shared.besides(docs.schema.fields, *dict(added))
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, general = (compressor(c, plan) for c in both.value)
        for b in batches:
            raw = b.column(text).cast(pa.binary()).to_pylist()
            i = [None if t is None else size_of(inside, t, plan) for t in raw]
            g = [None if t is None else size_of(general, t, plan) for t in raw]
            s = [None if x is None else (y - x) / y for x, y in zip(i, g, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(i, pa.int64()), pa.array(g, pa.int64()), pa.array(s, pa.float64())], names=[*names, *dict(added)])

    return docs.select(names).mapInArrow(run, T.StructType([*kept, *(T.StructField(n, t) for n, t in added)]))
