"""An agent's memory: texts with vectors and typed links, kept as versions of a graph store."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.operators import fused, graph_store, traverse
from trellium.operators.graph_store import Graph, Store
from trellium.settings import Request, Settings

MEMORY = "id long, kind string, text string, created_at timestamp, embedding array<double>"


class Memory:
    """Every write publishes memories and links together; a reader sees all of it or nothing."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = Settings()):
        self.spark, self.store, self.settings = spark, Store(spark, folder), settings
        if self.store.version() is None:
            self.store.publish(graph_store.set_identity(graph_store.empty(spark), True), memories=spark.createDataFrame([], MEMORY))

    @property
    def graph(self) -> Graph:
        return self.store.load()

    @property
    def memories(self) -> DataFrame:
        return self.store.table("memories")

    def store_memories(self, rows: list[tuple[str, str, list[float]]]) -> list[int]:
        """(kind, text, vector) each; ids are dense, as the vertices are."""
        g = self.graph
        now = datetime.datetime.now(datetime.UTC)
        ids = list(range(g.next_vid, g.next_vid + len(rows)))
        new = self.spark.createDataFrame([(i, k, t, now, [float(x) for x in v]) for i, (k, t, v) in zip(ids, rows, strict=True)], MEMORY)
        self.store.publish(graph_store.insert_vertices(g, len(rows)), memories=self.memories.unionByName(new))
        return ids

    def connect(self, src: int, dst: int, relation: str = "related_to") -> None:
        g, ids = graph_store.register_types(self.graph, [relation])
        self.store.publish(graph_store.insert_edge(g, src, dst, ids[relation]), memories=self.memories)

    def recall(self, vector: list[float], k: int = 5, mode: str = "fused", anchor: int | None = None, hops: int = 2) -> tuple[DataFrame, DataFrame]:
        """((rank, id, kind, text, dist), metrics): by vectors alone, from an anchor, or fused."""
        if mode not in ("fused", "vector"):
            raise ValueError("mode must be fused or vector")
        q = [(0, [float(x) for x in vector])]
        fields = "qid long, qvec array<double>"
        if mode == "vector":
            a = fused.vector_first(self.memories, self.spark.createDataFrame(q, fields), Request(k=k, m_seeds=0))
        elif anchor is not None:
            a = fused.anchored(self.memories, self.graph, self.spark.createDataFrame([(*q[0], anchor)], f"{fields}, src long"), Request(k=k, hops=hops), self.settings)
        else:
            a = fused.tjs_open(self.memories, self.graph, self.spark.createDataFrame(q, fields), Request(k=k, term_cond=64, m_seeds=4, hops=hops), self.settings)
        return a.rows.join(self.memories.drop("embedding", "created_at"), "id").select("rank", "id", "kind", "text", "dist").orderBy("rank"), a.metrics

    def neighbours(self, memory: int, relation: str | None = None, hops: int = 1) -> DataFrame:
        """(id, depth, kind, text) of what is linked within some hops, by one relation or any; an unknown relation links nothing."""
        g = self.graph
        kind = 0
        if relation is not None:
            row = g.types.where(F.col("name") == relation).first()
            if row is None:
                return self.memories.select("id", F.lit(0).alias("depth"), "kind", "text").limit(0)
            kind = row["id"]
        start = self.spark.createDataFrame([(0, memory)], "qid long, seed long")
        found, _ = traverse.bounded(g, start, hops, kind, self.settings.graph_work_budget)
        return found.select(F.col("vid").alias("id"), "depth").join(self.memories.select("id", "kind", "text"), "id")

    def stats(self) -> DataFrame:
        """One row: memories, links, relations."""
        g = self.graph
        return self.memories.agg(F.count("*").alias("memories")).crossJoin(g.live.agg(F.count("*").alias("links"))).crossJoin(g.types.agg(F.count("*").alias("relations")))
