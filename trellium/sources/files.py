"""Readers and writers of the formats that corpora come in. All readers split or list files on executors."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.functions import distance
from trellium.functions.text import copy_escape


def seed_corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, queries) of entities.csv(id, timestamp, chunk, embedding), edges.csv(src, dst) and queries.jsonl."""
    e = spark.read.csv(f"{folder}/entities.csv", header=True, schema="id long, timestamp int, chunk string, embedding string", escape='"', multiLine=True)
    e = e.select("id", F.col("timestamp").alias("ts"), "chunk", distance.vector_from_text(F.col("embedding")).alias("embedding"))
    edges = spark.read.csv(f"{folder}/edges.csv", header=True, schema="src long, dst long")
    q = spark.read.schema("qid string, embedding array<double>, selected_time_range array<int>").json(f"{folder}/queries.jsonl")
    return e, edges, q


def vectors(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, embedding) of .npy, .fvecs and .ivecs files, ids from 0 in each file's order; `limit` keeps the first rows."""
    kind = path.rsplit(".", 1)[-1]
    if kind not in ("npy", "fvecs", "ivecs"):
        raise ValueError(f"no reader for .{kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                m = parse_vectors(blob, kind)
                m = m if limit is None else m[:limit]
                for lo in range(0, len(m), 4096):
                    part = m[lo : lo + 4096]
                    yield pa.RecordBatch.from_pydict({"id": pa.array(range(lo, lo + len(part)), pa.int64()), "embedding": pa.array(list(part.astype(np.float32)), pa.list_(pa.float32()))})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id long, embedding array<float>")


def parse_vectors(blob: bytes, kind: str) -> np.ndarray:
    if kind == "npy":
        return np.load(io.BytesIO(blob))
    if not blob:
        return np.zeros((0, 0), np.float32)
    dim = struct.unpack("<i", blob[:4])[0]
    rows = np.frombuffer(blob, np.int32).reshape(-1, dim + 1)
    if (rows[:, 0] != dim).any():
        raise ValueError("rows differ in length")
    return rows[:, 1:] if kind == "ivecs" else rows[:, 1:].view(np.float32)


def wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, ns, redirect, timestamp, text) of a MediaWiki XML dump, compressed or not."""
    schema = "title string, ns int, redirect struct<_title:string>, revision struct<timestamp:string, text:struct<_VALUE:string>>"
    x = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return x.select("title", "ns", F.col("redirect._title").alias("redirect"), F.to_timestamp("revision.timestamp").alias("timestamp"), F.coalesce("revision.text._VALUE", F.lit("")).alias("text"))


def html_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(articles(id, title, html), redirects(source_title, target_title)) of a dump with one JSON page a line."""
    schema = "identifier long, name string, namespace struct<identifier:int>, article_body struct<html:string>, redirects array<struct<name:string>>"
    p = spark.read.schema(schema).json(path).where("coalesce(namespace.identifier, 0) = 0")
    articles = p.select(F.col("identifier").alias("id"), F.col("name").alias("title"), F.col("article_body.html").alias("html"))
    redirects = p.select(F.explode("redirects").alias("r"), F.col("name").alias("target_title")).select(F.col("r.name").alias("source_title"), "target_title")
    return articles, redirects


def write_compact(entities: DataFrame, path: str) -> None:
    """One line an entity: id, whether it is usable, and its links as p:d,p:d; compressed text."""
    links = F.array_join(F.transform("links", lambda x: F.concat_ws(":", x.getField("type_id").cast("string"), x.getField("dst").cast("string"))), ",")
    entities.select(F.concat_ws("\t", F.col("id").cast("string"), F.col("usable").cast("int").cast("string"), links).alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def read_compact(spark: SparkSession, path: str) -> DataFrame:
    """(id, usable, links) as written by write_compact."""
    parts = F.split("value", "\t")
    pairs = F.filter(F.split(F.element_at(parts, 3), ","), lambda x: x != "")
    link = lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("type_id"), F.split(x, ":")[1].cast("long").alias("dst"))
    return spark.read.text(path).select(parts[0].cast("long").alias("id"), (parts[1] == "1").alias("usable"), F.transform(pairs, link).alias("links"))


def write_shards(df: DataFrame, path: str, rows_per_file: int = 1_000_000, tsv: bool = False) -> None:
    """Shards of JSON lines, or of escaped tab-separated text, with a manifest (file, rows) beside them."""
    w = df
    if tsv:
        w = df.select(F.concat_ws("\t", *[copy_escape(F.coalesce(F.col(c).cast("string"), F.lit("\\N"))) if t == "string" else F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c, t in df.dtypes]).alias("value"))
    out = w.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
    out.text(f"{path}/data") if tsv else out.json(f"{path}/data")
    counts(df.sparkSession, path).write.mode("overwrite").parquet(f"{path}/manifest")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows) of the shards as they are."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.text(f"{path}/data").groupBy(name.alias("file")).agg(F.count("*").alias("rows"))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(file, expected, found) of shards that differ from their manifest; none: all is well."""
    m = spark.read.parquet(f"{path}/manifest").withColumnRenamed("rows", "expected")
    return m.join(counts(spark, path).withColumnRenamed("rows", "found"), "file", "full").where("expected is distinct from found")
