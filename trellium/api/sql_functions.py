"""Table functions for SQL over one graph: neighbours, traversals and the join-order decision."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellium.operators import traverse
from trellium.operators.graph_store import Graph
from trellium.plans import join_order


def register(spark: SparkSession, g: Graph, prefix: str = "gph") -> None:
    """Views {prefix}_edges(src, dst, type_id, seq) and {prefix}_neighbors(src, dst, ord), and functions to decide the join order.

    `SELECT dst FROM gph_neighbors WHERE src = 5` is pushed to the scan, as a call with a constant would be.
    """
    g.live.createOrReplaceTempView(f"{prefix}_edges")
    traverse.neighbours(g).createOrReplaceTempView(f"{prefix}_neighbors")
    spark.udf.register("choose_join_order", lambda m, n, t: join_order.choose(m, n, None if t is None else float(t)), T.StringType())
    spark.udf.register("choose_join_order_cost", lambda d, m, n, k: join_order.choose_by_cost(d, m, n, k), T.StringType())
    spark.udf.register("rel_selectivity", lambda m, n: float(join_order.selectivity(m, n)), T.DoubleType())
    spark.udf.register("estimate_intermediate", lambda m, k, o: join_order.intermediate(m, k, o), T.LongType())


def reach_table(spark: SparkSession, g: Graph, seed: int, depth: int, type_id: int = 0, name: str = "gph_reach") -> None:
    """The distinct vertices within some hops as a view (vid, depth)."""
    start = spark.createDataFrame([(0, seed)], "qid long, seed long")
    traverse.bfs(traverse.typed(g.live, type_id), start, depth).select("vid", F.col("depth")).createOrReplaceTempView(name)
