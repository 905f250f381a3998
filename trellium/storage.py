"""Shared folders, checkpoints and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only below this many bytes, counted.
BROADCAST_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset on one machine (tests), a new local one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='trellium-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint, if counting shows that it fits."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """df with dense numbers from start in the given order, without moving all rows to one task.

    Rows are sorted by range; each partition numbers its own, and partitions' offsets come from their counts.
    """
    if not df.columns:
        raise ValueError("no columns to number")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.withColumn("__part", F.spark_partition_id()))
    counts = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())  # a row for each partition
    offsets, at = [], start
    for part, n in counts:
        offsets.append((part, at))
        at += n
    by = df.sparkSession.createDataFrame(offsets, "__part int, __offset long")
    in_part = Window.partitionBy("__part").orderBy(*order)
    out = placed.join(F.broadcast(by), "__part").withColumn(name, (F.col("__offset") + F.row_number().over(in_part) - 1).cast("long"))
    return out.drop("__part", "__offset")
