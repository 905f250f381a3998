"""Where jobs keep what must outlive an executor, and checks of size before a broadcast."""

from __future__ import annotations

import gc
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured rows times its row width stay below this.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; where that is unset on one machine (tests), a new local one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str | None:
    """The path of a file: address or of a plain path; None for any other file system."""
    u = urlparse(uri)
    if u.scheme == "file":
        return unquote(u.path)
    return uri if not u.scheme else None


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder, with its lineage cut; lost executors don't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def kept_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and its place: as checkpoint, but compressed, nothing of its plan is kept, and `drop` can end it."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder), folder


def forget(spark: SparkSession) -> None:
    """Lets Spark delete now the shuffle files that nothing refers to any more.

    It does so whenever the driver happens to collect its garbage, which after a checkpoint may be long
    after the files have become useless; until then they take up the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes a table of this job that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most limit / row_bytes rows (counted, with a limit), else df as it is."""
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fresh(columns: list[str], *names: str) -> list[str]:
    """A name for each of `names` that none of the columns has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def besides(fields: list, *names: str) -> list:
    """The fields that aren't named like one of `names`, whatever the case: what stays beside results."""
    gone = {n.lower() for n in names}
    return [f for f in fields if f.name.lower() not in gone]


def digest(text: Column | str) -> Column:
    """SHA-256 of a text, the identity of exact copies."""
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)
