"""The fixed graph-query template: parsed, decided and lowered to one anchored search."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from trellium.operators import fused
from trellium.operators.graph_store import Graph
from trellium.plans import join_order
from trellium.settings import Request, Settings

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?"
_VECTOR = rf"(?:'\{{\s*{_NUMBER}(?:\s*,\s*{_NUMBER})*\s*\}}'|'\[\s*{_NUMBER}(?:\s*,\s*{_NUMBER})*\s*\]')"
TEMPLATE = re.compile(
    r"select (?P<dst>\w+)\.chunk from graph_table ?\( ?entity_graph match ?"
    r"\( ?(?P<src>\w+) is entity where (?P=src)\.id ?= ?(?P<id>\d+) ?\) ?"
    r"- ?\[ ?(?:\w+ )?is related_to ?\] ?-> ?\( ?(?P<to>\w+) is entity ?\) ?"
    r"where (?P=to)\.timestamp in ?\( ?(?P<ts>-?\d+(?: ?, ?-?\d+)*) ?\) ?"
    r"columns ?\( ?(?P=to)\.chunk, ?(?P=to)\.embedding ?\) ?\) (?:as )?(?P=dst) "
    rf"order by (?P=dst)\.embedding ?<-> ?(?P<vec>{_VECTOR}) limit (?P<k>\d+) ?;?",
    re.IGNORECASE,
)


@dataclass(frozen=True)
class Parsed:
    src: int
    ts: tuple[int, ...]
    vector: tuple[float, ...]
    k: int


@dataclass(frozen=True)
class Result:
    #: (rank, id, chunk)
    rows: DataFrame
    metrics: DataFrame
    join_order: str


def parse(text: str) -> Parsed:
    """Raises on anything but the template, before Spark is touched."""
    m = TEMPLATE.fullmatch(re.sub(r"\s+", " ", text).strip())
    if m is None:
        raise ValueError("the query doesn't follow the template")
    k = int(m["k"])
    if not 1 <= k <= 10_000:
        raise ValueError("LIMIT must be between 1 and 10000")
    return Parsed(int(m["id"]), tuple(int(x) for x in m["ts"].split(",")), tuple(float(x) for x in m["vec"][2:-2].split(",")), k)


def graph_query(spark: SparkSession, text: str, entities: DataFrame, g: Graph, settings: Settings = Settings()) -> Result:
    """Chunks of the source's `related_to` neighbours in a set of times, nearest first.

    Both join orders give the same rows, and a source is always given, so the anchored search (filter_first) runs.
    """
    p = parse(text)
    kind = g.types.where("name = 'related_to'").select("id").first()
    if kind is None:
        raise ValueError("the edge type related_to is not registered")
    where = f"ts IN ({', '.join(map(str, p.ts))})"
    q = spark.createDataFrame([(0, list(p.vector), p.src)], "qid long, qvec array<double>, src long")
    a = fused.anchored(entities, g, q, Request(k=p.k, hops=1, edge_type=kind["id"], where=where), settings)
    rows = a.rows.join(entities.select("id", "chunk"), "id").select("rank", "id", "chunk").orderBy("rank")
    return Result(rows, a.metrics, join_order.FILTER_FIRST)
