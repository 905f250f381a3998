"""Grades of one answer against another, as expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def recall(got: Column, truth: Column) -> Column:
    """Share of distinct true ids that were found; where nothing is true, 1 if nothing was returned."""
    n = F.size(F.array_distinct(truth))
    return F.when(n == 0, (F.size(got) == 0).cast("double")).otherwise(F.size(F.array_intersect(got, truth)) / n)


def jaccard(a: Column, b: Column) -> Column:
    """Two empty sets are the same."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def evidence(got: Column, gold: Column) -> Column:
    """struct(recall, joint, f1): joint is 1 where all the gold was found."""
    hit, n, m = F.size(F.array_intersect(got, gold)), F.size(F.array_distinct(gold)), F.size(F.array_distinct(got))
    r = F.when(n > 0, hit / n).otherwise(0.0)
    p = F.when(m > 0, hit / m).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return F.struct(r.alias("recall"), ((n > 0) & (hit == n)).cast("double").alias("joint"), f1.alias("f1"))
