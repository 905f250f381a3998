"""How an adjacency list fills fixed pages, as columns over a table of degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE, HEADER, SPECIAL, SLOT = 32768, 24, 16, 32
SLOTS = (PAGE - HEADER - SPECIAL) // SLOT


def layout(degrees: DataFrame, degree: str = "degree", tail_cap: int = SLOTS, hub_from: int = SLOTS) -> DataFrame:
    """degrees with pages, delta_tail, sorted_run, is_hub and image_bytes of one insert; a negative degree is an error."""
    d = F.when(F.col(degree) < 0, F.raise_error(F.lit("a degree is negative")).cast("long")).otherwise(F.col(degree).cast("long"))
    out = degrees.withColumn("pages", F.ceil(d / SLOTS).cast("long")).withColumn("delta_tail", F.least(d, F.lit(tail_cap)).cast("long"))
    out = out.withColumn("sorted_run", (d - F.col("delta_tail")).cast("long")).withColumn("is_hub", d >= hub_from)
    return out.withColumn("image_bytes", F.when(d > 0, PAGE).otherwise(0).cast("long"))


def shift(position: Column, run: Column) -> Column:
    """Slots that an insert in place moves."""
    return F.when((position < 0) | (position > run), F.raise_error(F.lit("position outside the run")).cast("long")).otherwise(run - position)


def amortized(tail_cap: Column, run: Column) -> Column:
    """Slots moved for each insert when a tail of that many is merged at once."""
    return (run + tail_cap) / tail_cap
