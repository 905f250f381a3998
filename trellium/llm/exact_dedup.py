"""Exact deduplication that doesn't let a frequent text overload one task.

Two texts are copies when their SHA-256 digests are equal.  A Misra-Gries summary of the digests
names every digest that makes up more than 1 / `counters` of the table.  One exact count over the
table verifies those candidates and finds the winner (the smallest doc_id) of each; winners are
broadcast (at most `counters` of them, whatever the table's size), and their copies are dropped
where they are read.  All other digests go through an ordinary shuffle, of digests and ids alone.

Nulls: a row with a null text is no copy of anything and stays.  A null doc_id counts as larger
than any other, so it wins only among null ids.  Empty texts are copies of each other.  Rows that
repeat both text and doc_id are copies too, and one of them stays.  Ties can't arise between
different ids.  Extra columns stay.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

COUNTERS = 512


class MisraGries:
    """At most k counters over a stream of keys; each true count is at most `lost` above its counter."""

    def __init__(self, k: int):
        self.k, self.counts, self.lost = k, {}, 0

    def add(self, counts: dict[str, int]) -> None:
        held = self.counts
        for key, n in counts.items():
            held[key] = held.get(key, 0) + n
        if len(held) > self.k:
            cut = sorted(held.values(), reverse=True)[self.k]
            self.lost += cut
            self.counts = {key: n - cut for key, n in held.items() if n > cut}


def _summaries(df: DataFrame, k: int) -> DataFrame:
    """One summary for each partition of (key, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mg = MisraGries(k)
        for b in batches:
            part: dict[str, int] = {}
            for key, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part[key] = part.get(key, 0) + n
            mg.add(part)
        yield pa.RecordBatch.from_pydict({"key": pa.array(list(mg.counts), pa.string()), "n": pa.array(list(mg.counts.values()), pa.int64())})

    return df.mapInArrow(run, "key string, n bigint")


def heavy_hitters(keys: DataFrame, key: str, k: int = COUNTERS) -> DataFrame:
    """(key, n): at most k keys, among them every key with more than rows / (k + 1) rows; n is a lower bound of its count.

    Summaries are merged as a tree: by 64 at a time, then the rest into one.
    """
    parts = _summaries(keys.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lit(1).cast("bigint").alias("n")), k)
    merged = _summaries(parts.withColumn("part", F.spark_partition_id() % 64).repartition(64, "part").select("key", "n"), k)
    return _summaries(merged.coalesce(1), k)


def split(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> tuple[DataFrame, DataFrame]:
    """(winners, copies_of_rest): verified frequent digests with winner and count; the same for every other digest."""
    keyed = docs.where(F.col(text).isNotNull()).select(shared.digest(text).alias("digest"), F.col(doc_id).alias("id"))
    keyed = shared.checkpoint(keyed)  # 72 bytes a row in the shared folder, in place of reading and hashing texts again
    frequent = [r["key"] for r in heavy_hitters(keyed, "digest", counters).collect()]
    names = F.broadcast(keyed.sparkSession.createDataFrame([(k,) for k in frequent], "digest string"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    # the group is tiny after the map side's partial counts: at most `counters` rows from each task
    found = keyed.join(names, "digest", "left_semi").groupBy("digest").agg(best["id"].alias("winner"), F.count("*").alias("copies")).where("copies > 1")
    winners = [tuple(r) for r in found.collect()]
    table = keyed.sparkSession.createDataFrame(winners, T.StructType([T.StructField("digest", T.StringType()), T.StructField("winner", docs.schema[doc_id].dataType), T.StructField("copies", T.LongType())]))
    rest = keyed.join(F.broadcast(table.select("digest")), "digest", "left_anti")
    return table, rest.groupBy("digest").agg(best["id"].alias("winner"), F.count("*").alias("copies"))


def kept(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """(doc_id, digest, copies) of each row that stays; copies: how many rows hold its text."""
    winners, rest = split(docs, text, doc_id, counters)
    none = docs.where(F.col(text).isNull()).select(F.col(doc_id).alias("doc_id"), F.lit(None).cast("string").alias("digest"), F.lit(1).cast("bigint").alias("copies"))
    return winners.unionByName(rest).select(F.col("winner").alias("doc_id"), "digest", "copies").unionByName(none)


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", counters: int = COUNTERS) -> DataFrame:
    """docs without the copies, all columns as they were.

    Only ids and digests are shuffled to find the losers; a text moves only if the losers don't fit a broadcast.
    """
    cols = docs.columns
    own, winner, hot = shared.fresh(cols, "digest", "winner", "hot")
    keyed = docs.withColumn(own, shared.digest(text))
    winners, rest = split(docs, text, doc_id, counters)
    frequent = F.broadcast(winners.select(F.col("digest").alias(own), F.col("winner").alias(winner), F.lit(True).alias(hot)))
    multiple = rest.where("copies > 1").select(F.col("digest").alias(own), F.col("winner").alias(winner), F.lit(False).alias(hot))
    multiple = shared.small(shared.checkpoint(multiple), 120)
    first = keyed.join(frequent, own, "left")
    alone = first.where(F.col(hot).isNull()).drop(winner, hot).join(multiple, own, "left")
    same = F.col(hot).isNotNull() & F.col(doc_id).eqNullSafe(F.col(winner))
    unique = alone.where(F.col(hot).isNull())
    chosen = alone.where(same).unionByName(first.where(same))
    # rows that repeat both text and id: one stays, and each task keeps one before they meet
    return unique.select(cols).unionByName(chosen.dropDuplicates([own]).select(cols))
