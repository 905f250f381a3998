"""Distances between vector columns, in double precision and inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked(a: Column, b: Column) -> Column:
    """b, or an error where lengths differ or an element is null; null where either is null."""
    bad = (F.size(a) != F.size(b)) | F.exists(a, lambda x: x.isNull()) | F.exists(b, lambda x: x.isNull())
    return F.when(a.isNull() | b.isNull(), None).when(bad, F.raise_error(F.lit("vectors differ in length or have null elements"))).otherwise(b)


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine; a vector of length 0 is at distance 1 from all."""
    n = norm(a) * norm(b)
    return F.lit(1.0) - F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def negative_ip(a: Column, b: Column) -> Column:
    """The inner product, negated so that the nearest come first."""
    return -dot(a, b)


BY_METRIC = {"l2": l2, "cosine": cosine, "ip": negative_ip}


def unit(a: Column) -> Column:
    """a at length 1; a vector of length 0 stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: (x.cast("double") / F.when(n > 0, n).otherwise(1.0)).cast("double"))


def in_range(v: Column, radius_and_centre: Column) -> Column:
    """Whether v is within a radius of a centre, both in one array: the radius, then the centre."""
    n = F.size(radius_and_centre)
    centre = F.slice(radius_and_centre, 2, F.greatest(n - 1, F.lit(0)))
    ok = l2(v, centre) <= F.element_at(radius_and_centre, 1).cast("double")
    return F.when(n != F.size(v) + 1, F.raise_error(F.lit("a range takes a radius and a vector of the column's length")).cast("boolean")).otherwise(ok)


def vector_from_text(text: Column) -> Column:
    """An array of doubles from '{1,2}' or '[1,2]'; null where the brackets don't match."""
    t = F.trim(text)
    ok = t.rlike(r"^(\{[^{}\[\]]*\}|\[[^{}\[\]]*\])$")
    return F.when(ok, F.transform(F.split(F.regexp_replace(t, r"^[\{\[]|[\}\]]$", ""), ","), lambda x: F.trim(x).cast("double")))
