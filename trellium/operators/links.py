"""Link prediction over a directed graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellium.operators.traverse import in_degree


def common(edges: DataFrame, pairs: DataFrame, leave_out: bool = False) -> DataFrame:
    """(a, b, common, adamic_adar) of pairs(a, b): shared out-neighbours, and their sum of 1 / ln(max(in-degree, 2)).

    leave_out drops from a's links those to its own candidates, so that a test link can't vouch for another.
    """
    e = edges.select("src", "dst").distinct()
    weight = in_degree(e).select(F.col("vid").alias("w"), (F.lit(1.0) / F.log(F.greatest("indeg", F.lit(2)).cast("double"))).alias("aa"))
    pairs = pairs.select("a", "b").distinct()
    out_a = e.select(F.col("src").alias("a"), F.col("dst").alias("w"))
    if leave_out:
        out_a = out_a.join(pairs.select("a", F.col("b").alias("w")), ["a", "w"], "left_anti")
    shared = pairs.join(out_a, "a").join(e.select(F.col("src").alias("b"), F.col("dst").alias("w")), ["b", "w"]).join(weight, "w")
    found = shared.groupBy("a", "b").agg(F.count("*").alias("common"), F.sum("aa").alias("adamic_adar"))
    return pairs.join(found, ["a", "b"], "left").fillna({"common": 0, "adamic_adar": 0.0})


def all_common(edges: DataFrame) -> DataFrame:
    """(a, b, common, adamic_adar) of every pair a < b that shares an out-neighbour."""
    e = edges.select("src", "dst").distinct()
    weight = in_degree(e).select(F.col("vid").alias("dst"), (F.lit(1.0) / F.log(F.greatest("indeg", F.lit(2)).cast("double"))).alias("aa"))
    left = e.select(F.col("src").alias("a"), "dst").join(weight, "dst")
    return left.join(e.select(F.col("src").alias("b"), "dst"), "dst").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"), F.sum("aa").alias("adamic_adar"))


def unlinked(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates (a, b, rank) that a doesn't link to and isn't, ranked anew in the same order."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    left = ranked.where("a <> b").join(e, ["a", "b"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("rank", "b")).cast("long"))


def linked_fraction(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, fraction): share of a's candidates that it links to."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct().withColumn("hit", F.lit(1))
    return ranked.join(e, ["a", "b"], "left").groupBy("a").agg((F.count("hit") / F.count("*")).alias("fraction"))


def overlap_at(ranked: DataFrame, edges: DataFrame, score: Column, k: int) -> DataFrame:
    """(a, overlap): share of true links among the k best candidates (a, b, rank) by a score; ties keep the rank's order."""
    top = ranked.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(score.desc(), "rank"))).where(F.col("r") <= k)
    return linked_fraction(top.select("a", "b"), edges).select("a", F.col("fraction").alias("overlap"))
