"""Verdicts over measured runs, operating points, and statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellium.functions import sets

TARGETS = {"SM-1": 5.0, "SM-2": 0.8, "SM-3": 0.25, "SM-4": 0.99, "SM-5": 1.0}


def verdicts(own: DataFrame, other: DataFrame) -> DataFrame:
    """(sm, value, target, passed) of samples (qid, k, latency_ms, peak_rows, examined, corpus, chunks, atomic) of two systems."""
    a = own.agg(F.sum("peak_rows").alias("p"))
    b = other.agg(F.sum("peak_rows").alias("o"))
    sm1 = a.crossJoin(b).select(F.lit("SM-1").alias("sm"), F.coalesce(F.col("o") / F.when(F.col("p") != 0, F.col("p")), F.when(F.col("o") > 0, F.lit(float("inf"))).otherwise(0.0)).alias("value"))
    pair = own.join(other.select("qid", F.col("latency_ms").alias("l2"), F.col("chunks").alias("c2")), "qid")
    sm2 = pair.agg(F.coalesce(F.avg((F.col("latency_ms") < F.col("l2")).cast("double")), F.lit(0.0)).alias("value")).select(F.lit("SM-2").alias("sm"), "value")
    share = F.when(F.col("corpus") > 0, F.col("examined") / F.col("corpus")).otherwise(0.0)
    sm3 = own.agg(F.coalesce(F.max(F.when(F.col("k") == 5, share)), F.max(share), F.lit(1.0)).alias("value")).select(F.lit("SM-3").alias("sm"), "value")
    sm4 = pair.agg(F.coalesce(F.avg(sets.jaccard(F.col("chunks"), F.col("c2"))), F.lit(0.0)).alias("value")).select(F.lit("SM-4").alias("sm"), "value")
    sm5 = own.agg(F.coalesce(F.avg(F.col("atomic").cast("double")), F.lit(0.0)).alias("value")).select(F.lit("SM-5").alias("sm"), "value")
    out = sm1.unionByName(sm2).unionByName(sm3).unionByName(sm4).unionByName(sm5)
    target = F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv])[F.col("sm")]
    ok = F.when(F.col("sm") == "SM-3", F.col("value") < F.col("target")).otherwise(F.col("value") >= F.col("target"))
    return out.withColumn("target", target).withColumn("passed", ok)


def latency_summary(samples: DataFrame, by: str, value: str = "latency_ms") -> DataFrame:
    """(by, median, p95), exact and interpolated."""
    return samples.groupBy(by).agg(F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.95).alias("p95"))


def operating_point(curve: DataFrame, target: float) -> DataFrame:
    """The fastest setting of curve(tag, recall, latency) whose recall reaches the target."""
    ok = curve.where(~F.isnan("recall") & (F.col("recall") >= target))
    return ok.agg(F.min_by(F.struct("tag", "recall", "latency"), F.struct("latency", "tag")).alias("p")).where("p is not null").select("p.*")


def blockers(own: dict | None, other: dict | None, facts: dict, eps: float = 0.02, least_builds: int = 3) -> list[str]:
    """What forbids publishing a ratio of latencies; none: an empty list.

    facts: own_edges, other_edges, same_timer, healthy_builds, builds, cap.
    """
    out = []
    a, b = facts.get("own_edges"), facts.get("other_edges")
    if a is None or b is None:
        out.append("edge counts unknown")
    elif a != b:
        out.append("edge counts differ")
    if not facts.get("same_timer"):
        out.append("timers at different boundaries")
    good, all_ = facts.get("healthy_builds"), facts.get("builds")
    if good is None or all_ is None:
        out.append("index builds undeclared")
    elif all_ < least_builds or good < all_:
        out.append("index builds not reproducible")
    if own is None or other is None:
        return [*out, "no matched operating point"]
    if abs(own["recall"] - other["recall"]) > eps:
        out.append("recall not matched")
    seen = own.get("examined")
    if seen is not None and not math.isnan(seen):
        if seen <= 0:
            out.append("nothing examined")
        if facts.get("cap") and seen >= facts["cap"]:
            out.append("censored by the work cap")
    return out


def spearman(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """(by, rho): correlation of mean ranks; null where one side is constant."""
    def mean_rank(c: str):
        return F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2

    r = df.withColumn("__x", mean_rank(x)).withColumn("__y", mean_rank(y))
    one = Window.partitionBy(by)
    varies = (F.min("__x").over(one) < F.max("__x").over(one)) & (F.min("__y").over(one) < F.max("__y").over(one))
    # corr divides by zero in a flat group, even where its result isn't used
    r = r.withColumn("__varies", varies)
    return r.groupBy(by).agg(F.corr(F.when(F.col("__varies"), F.col("__x")), F.when(F.col("__varies"), F.col("__y"))).alias("rho"))


def bootstrap(values: np.ndarray, rounds: int = 4000, seed: int = 7, level: float = 0.95) -> tuple[float, float, float]:
    """(mean, low, high) of the mean of one figure a query, by seeded resampling."""
    v = np.asarray(values, float)
    if not len(v):
        return math.nan, math.nan, math.nan
    rng = np.random.default_rng(seed)
    means = np.array([v[rng.integers(0, len(v), len(v))].mean() for _ in range(rounds)])
    edge = (1 - level) / 2 * 100
    return float(v.mean()), float(np.percentile(means, edge)), float(np.percentile(means, 100 - edge))


def signed_rank(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(W, p) of the paired signed-rank test by the normal approximation with ties."""
    d = np.asarray(a, float) - np.asarray(b, float)
    d = d[d != 0]
    n = len(d)
    if not n:
        return 0.0, 1.0
    size = np.abs(d)
    values, back, counts = np.unique(size, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[back]
    w = min(rank[d > 0].sum(), rank[d < 0].sum())
    var = n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48
    return float(w), float(math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(var) / math.sqrt(2)))


def by_frequency(rows: DataFrame, id_col: str, array: str, low: int, high: int) -> DataFrame:
    """(id, type, members): of each row's types, the one with fewest members among those with low to high; ties by type."""
    each = rows.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(array)).alias("type"))
    n = each.groupBy("type").agg(F.count("*").alias("members")).where(F.col("members").between(low, high))
    return each.join(n, "type").groupBy("id").agg(F.min(F.struct("members", "type")).alias("t")).select("id", "t.type", "t.members")
