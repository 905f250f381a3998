"""Edit streams: framing, filtering, latest state, torn reads; over batches and with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trellium.functions.text import item_id

EDIT = "wiki string, namespace int, type string, title string, timestamp long, user string, comment string, revision struct<new:long>"


def frames(lines: Iterable[str]) -> Iterator[tuple[str | None, str]]:
    """(id, data) of server-sent events: data lines joined, comments skipped, an unfinished last event kept."""
    cursor, data = None, []
    for line in lines:
        line = line.rstrip("\r\n")
        if not line:
            if data:
                yield cursor, "\n".join(data)
            cursor, data = None, []
        elif not line.startswith(":"):
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "data":
                data.append(value)
            elif name == "id":
                cursor = value
    if data:
        yield cursor, "\n".join(data)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(file, event_id, data) of recorded event streams, one file a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, i, d) for f, v in zip(b["file"], b["value"], strict=True) for i, d in frames(v.split("\n"))]
            yield pd.DataFrame(rows, columns=["file", "event_id", "data"])

    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return raw.mapInPandas(run, "file string, event_id string, data string")


def edits(changes: DataFrame, data: str = "data") -> DataFrame:
    """(entity, rev, ts, user, comment) of usable edits: of items, in namespace 0, with a revision. Works on streams too."""
    j = changes.select(F.from_json(data, EDIT).alias("j")).select("j.*")
    ok = j.where("wiki = 'wikidatawiki' and namespace = 0 and type = 'edit' and revision.new is not null")
    e = ok.select(item_id(F.col("title")).alias("entity"), F.col("revision.new").alias("rev"), F.col("timestamp").alias("ts"), "user", "comment")
    return e.where("entity is not null")


class _Full(Exception):
    """Ends a recording before a batch that nothing is written of, so that it isn't committed."""


def record(source: DataFrame, sink: str, checkpoint: str, most: int | None = None, seconds: float | None = None) -> int:
    """Appends what is available of a streaming DataFrame of edits to Parquet and stops; a later call goes on where this one ended.

    Each micro-batch has a folder of its own that is overwritten when the batch is repeated, so each edit is recorded once.
    With `most`, recording ends after the batch in which that many are held, with `seconds`, after the batch in which they
    are over; the next batch isn't committed, and the next call begins with it, so no edit is lost.
    """
    spark = source.sparkSession
    held, full, began = [0], [False], time.monotonic()

    def keep(batch: DataFrame, n: int) -> None:
        if (most is not None and held[0] >= most) or (seconds is not None and time.monotonic() - began >= seconds):
            full[0] = True
            raise _Full
        batch.write.mode("overwrite").parquet(f"{sink}/batch={n}")
        held[0] += spark.read.parquet(f"{sink}/batch={n}").count()

    q = source.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    try:
        q.awaitTermination()
    except StreamingQueryException:
        if not full[0]:
            raise
    return held[0]


def latest(edits_: DataFrame) -> DataFrame:
    """(entity, rev): the largest revision of each entity."""
    return edits_.where("entity is not null and rev is not null").groupBy("entity").agg(F.max("rev").alias("rev"))


def latest_stream(edits_: DataFrame) -> DataFrame:
    """latest() of a stream: a row each time an entity's revision rises, so that replays stay monotone."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had = state.get[0] if state.exists else None
        top = max([int(b["rev"].max()) for b in batches if len(b)], default=None)
        if top is not None and (had is None or top > had):
            state.update((top,))
            yield pd.DataFrame({"entity": [key[0]], "rev": [top]})

    s = edits_.where("entity is not null and rev is not null").select("entity", "rev")
    return s.groupBy("entity").applyInPandasWithState(run, "entity long, rev long", "rev long", "append", GroupStateTimeout.NoTimeout)


LEGS = ("vector", "graph", "relational")


def torn_reads(edits_: DataFrame, atomic: bool, start: int = 0) -> DataFrame:
    """(observations, torn, torn_rate) of a reader that looks at an entity after each commit of edits(entity, rev, ord).

    Atomic: one commit an edit. Otherwise a commit a leg: until the last the legs disagree, if the revision changed.
    """
    before = F.coalesce(F.lag("rev").over(Window.partitionBy("entity").orderBy("ord")), F.lit(start))
    e = edits_.where("entity is not null and rev is not null").withColumn("before", before)
    legs = 1 if atomic else len(LEGS)
    seen = e.withColumn("leg", F.explode(F.sequence(F.lit(1), F.lit(legs))))
    torn = (F.col("leg") < legs) & (F.col("rev") != F.col("before"))
    out = seen.agg(F.count("*").alias("observations"), F.coalesce(F.sum(torn.cast("long")), F.lit(0)).cast("long").alias("torn"))
    return out.withColumn("torn_rate", F.when(F.col("observations") > 0, F.col("torn") / F.col("observations")).otherwise(0.0))


def per_shard(spark: SparkSession, source: str, schema: str, work, sink: str, checkpoint: str) -> None:
    """work(DataFrame) -> DataFrame over each new file of JSON lines once; what was done is kept, and a broken run goes on."""

    def keep(batch: DataFrame, n: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={n}")

    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    s.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def windows(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Beyond what the engine's stores need: counts and sums in tumbling windows, with a bound on lateness."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), by, "n", "total")
