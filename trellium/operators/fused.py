"""Vector, graph and relational evidence ranked into one top-k, for batches of queries.

A vector stream here is exact: entities by (dist, id).  On such a stream the counters that a streaming search
keeps are functions of ranks: once k candidates are held nothing later improves them, so with `term_cond` t > 0
the stream ends at accepted candidate number max(window, k) + t.

Nulls: rows with a null id or vector never rank and aren't counted; a filter that is null rejects.  Ties go by id.
A query without rows gives no rows, but has its row of metrics.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellium.functions import distance
from trellium.operators import push, vector
from trellium.operators.graph_store import Graph
from trellium.operators.traverse import reach, typed
from trellium.settings import Request, Settings
from trellium.storage import cut


@dataclass(frozen=True)
class Answer:
    #: (qid, rank, id, dist[, score])
    rows: DataFrame
    #: (qid, examined, bridges, graph_examined, graph_censored, termination_reason, budget_capped)
    metrics: DataFrame


def to_spark_sql(fragment: str) -> str:
    """A filter with @>, && and ARRAY[...] in Spark's spelling."""
    f = re.sub(r"(?i)\barray\s*\[([^\]]*)\]", r"array(\1)", fragment)
    f = re.sub(r"(\w+)\s*@>\s*(array\([^)]*\))", r"(size(array_except(\2, \1)) = 0)", f)
    return re.sub(r"(\w+)\s*&&\s*(array\([^)]*\))", r"arrays_overlap(\1, \2)", f)


def passing(entities: DataFrame, where: str) -> DataFrame:
    """Rows that satisfy a trusted SQL condition, which may call registered functions and have subqueries."""
    if not where.strip():
        return entities
    view = f"entities_{uuid.uuid4().hex}"
    entities.createOrReplaceTempView(view)
    try:
        return entities.sparkSession.sql(f"SELECT * FROM {view} WHERE ({to_spark_sql(where)})")
    finally:
        entities.sparkSession.catalog.dropTempView(view)


def _usable(entities: DataFrame) -> DataFrame:
    return entities.where("id is not null and embedding is not null")


def anchored(entities: DataFrame, g: Graph, queries: DataFrame, request: Request, settings: Settings = Settings()) -> Answer:
    """Reach first: what queries(qid, qvec, src) reach from their anchors, filtered, then ranked by exact distance.

    The anchor itself is never a result.  With term_cond the candidates are taken in the order in which the
    traversal finds them, and those after `term_cond` drops in a row are never looked at.
    """
    q = queries.where("src is not null")
    found, steps = reach(q.select("qid", F.col("src").alias("seed")), typed(g.live, request.edge_type), request.hops, settings.graph_work_budget)
    found = found.where("depth > 0").select("qid", F.col("vid").alias("id"), "ord")
    ok = _usable(passing(entities, request.where)).select("id", "embedding")
    cand = found.join(ok, "id").join(q.select("qid", "qvec", "src"), "qid").where("id <> src")
    d = distance.BY_METRIC[request.metric](F.col("embedding"), distance.checked(F.col("embedding"), F.col("qvec")))
    cand = cand.select("qid", "id", "ord", d.alias("dist")).where("dist is not null")
    steps = steps.select("qid", F.col("steps").alias("graph_examined"), (F.col("steps") >= settings.graph_work_budget).alias("graph_censored"))
    if request.term_cond:
        ran = _replay(cand, request.k, request.term_cond)
        ran = cut(ran)
        picked = ran.where("kept").select("qid", "id", "ord", "dist")
        examined = ran.groupBy("qid").agg(F.count("*").alias("examined"), F.max(F.when(F.col("stopped"), F.col("ord"))).alias("upto"))
        steps = steps.join(examined.select("qid", "upto"), "qid", "left").select("qid", F.coalesce("upto", "graph_examined").alias("graph_examined"), (F.col("graph_censored") & F.col("upto").isNull()).alias("graph_censored"))
        examined = examined.drop("upto")
    else:
        cand = cut(cand)
        first = Window.partitionBy("qid").orderBy("dist", "ord")
        picked = cand.withColumn("r", F.row_number().over(first)).where(F.col("r") <= request.k).drop("r")
        examined = cand.groupBy("qid").agg(F.count("*").alias("examined"))
    rows = _emit(picked, "dist")
    m = queries.select("qid").join(examined, "qid", "left").join(steps, "qid", "left")
    metrics = m.select(
        "qid",
        F.coalesce("examined", F.lit(0)).cast("long").alias("examined"),
        F.lit(0).cast("long").alias("bridges"),
        F.coalesce("graph_examined", F.lit(0)).cast("long").alias("graph_examined"),
        F.coalesce("graph_censored", F.lit(False)).alias("graph_censored"),
        F.lit("filter_first").alias("termination_reason"),
        F.lit(False).alias("budget_capped"),
    )
    return Answer(rows, metrics)


def _replay(cand: DataFrame, k: int, term_cond: int) -> DataFrame:
    """Candidates that were looked at, in arrival order; kept: in the final heap; stopped: the query ended before its last."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("ord").reset_index(drop=True)
        heap: list[tuple[float, int]] = []
        drops, seen = 0, 0
        for i, d in enumerate(t["dist"]):
            seen = i + 1
            if len(heap) < k:
                heap.append((d, i))
                drops = 0
            else:
                worst = max(heap)
                if d < worst[0]:
                    heap[heap.index(worst)] = (d, i)
                    drops = 0
                else:
                    drops += 1
                    if drops >= term_cond:
                        break
        t = t.iloc[:seen].copy()
        t["kept"] = False
        t.loc[[i for _, i in heap], "kept"] = True
        t["stopped"] = drops >= term_cond
        return t

    return cand.groupBy("qid").applyInPandas(run, "qid long, id long, ord long, dist double, kept boolean, stopped boolean")


def _emit(picked: DataFrame, key: str, *more: str) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col(key).desc() if key == "score" else key, "id")
    return picked.select("qid", F.row_number().over(order).cast("long").alias("rank"), "id", "dist", *more)


@dataclass(frozen=True)
class _Stream:
    #: (qid, id, dist, rank): accepted candidates in the order of the stream, up to its end or at least the first k.
    passers: DataFrame
    #: (qid, examined, termination_reason, budget_capped)
    end: DataFrame


def _stream(entities: DataFrame, queries: DataFrame, request: Request, settings: Settings, window: int) -> _Stream:
    k, budget = request.k, settings.vector_scan_budget
    every = _usable(entities).select("id", "embedding")
    ok = _usable(passing(entities, request.where)).select("id", "embedding")
    qs = queries.select("qid", "qvec")
    total = every.count()
    stop = max(window, k) + request.term_cond if request.term_cond else None
    if budget:
        delivered = cut(vector.knn(qs, every, budget, request.metric))
        within = delivered.join(ok.select("id"), "id", "left_semi")
        within = within.withColumn("p", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
        stops = within.where(F.col("p") == stop).select("qid", F.col("rank").alias("at")) if stop else None
        end = qs.select("qid")
        end = end.join(stops, "qid", "left") if stop else end.withColumn("at", F.lit(None).cast("long"))
        capped = F.col("at").isNull() & F.lit(total >= budget)
        end = end.select(
            "qid",
            F.coalesce("at", F.lit(min(budget, total))).cast("long").alias("examined"),
            F.when(F.col("at").isNotNull(), "term_cond").when(capped, "scan_budget").otherwise("stream_end_unknown").alias("termination_reason"),
            F.when(F.col("at").isNotNull(), False).when(capped, True).alias("budget_capped"),
        )
        upto = within.join(end.select("qid", "examined"), "qid").where("rank <= examined").select("qid", "id", "dist", F.col("p").cast("long").alias("rank"))
        return _Stream(upto, end)
    if not stop:
        end = qs.select("qid", F.lit(total).cast("long").alias("examined"), F.lit("stream_end_unknown").alias("termination_reason"), F.lit(None).cast("boolean").alias("budget_capped"))
        return _Stream(cut(vector.knn(qs, ok, max(k, window), request.metric)), end)
    passers = cut(vector.knn(qs, ok, stop, request.metric))
    last = passers.where(F.col("rank") == stop).select("qid", F.col("dist").alias("bound"), F.col("id").alias("bound_id"))
    n = vector.count_upto(qs.join(last, "qid"), every, request.metric)
    end = qs.select("qid").join(n, "qid", "left").select(
        "qid",
        F.coalesce("n", F.lit(total)).cast("long").alias("examined"),
        F.when(F.col("n").isNotNull(), "term_cond").otherwise("stream_end_unknown").alias("termination_reason"),
        F.when(F.col("n").isNotNull(), False).alias("budget_capped"),
    )
    return _Stream(passers, end)


def _metrics(end: DataFrame, extra: DataFrame | None) -> DataFrame:
    if extra is None:
        zero = [F.lit(0).cast("long").alias(c) for c in ("bridges", "graph_examined")]
        return end.select("qid", "examined", *zero, F.lit(False).alias("graph_censored"), "termination_reason", "budget_capped")
    m = end.join(extra, "qid", "left")
    return m.select(
        "qid",
        (F.col("examined") + F.coalesce("fetched", F.lit(0))).cast("long").alias("examined"),
        F.coalesce("bridges", F.lit(0)).cast("long").alias("bridges"),
        F.coalesce("graph_examined", F.lit(0)).cast("long").alias("graph_examined"),
        F.coalesce("graph_censored", F.lit(False)).alias("graph_censored"),
        "termination_reason",
        "budget_capped",
    )


def vector_first(entities: DataFrame, queries: DataFrame, request: Request, settings: Settings = Settings()) -> Answer:
    """The stream, filtered, to k accepted candidates; no graph."""
    s = _stream(entities, queries, request, settings, 0)
    return Answer(_emit(s.passers.where(F.col("rank") <= request.k).drop("rank"), "dist"), _metrics(s.end, None))


def _fetched(entities: DataFrame, queries: DataFrame, request: Request, members: DataFrame) -> DataFrame:
    """members(qid, id, ...) that pass the filter, with their distance."""
    ok = _usable(passing(entities, request.where)).select("id", "embedding")
    dist = vector.measured(members, queries, ok, request.metric)
    return dist.join(members, ["qid", "id"]) if len(members.columns) > 2 else dist


def _fill(pool: DataFrame, k: int, *more: str) -> DataFrame:
    """k of pool(qid, id, dist, bridge, place, ...): bridges first up to half of k (one at least), then by place."""
    cap = max(k // 2, 1)
    best = Window.partitionBy("qid", "bridge").orderBy("place", "id")
    claim = F.when(F.col("bridge") & (F.row_number().over(best) <= cap), 0).otherwise(F.col("then"))
    ranked = pool.withColumn("claim", claim)
    order = Window.partitionBy("qid").orderBy("claim", "place", "id")
    return ranked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("qid", "id", "dist", *more)


def membership(entities: DataFrame, g: Graph, queries: DataFrame, request: Request, settings: Settings = Settings()) -> Answer:
    """Seeds are the nearest accepted candidates; what they reach is guaranteed up to half of the k places."""
    k, m = request.k, request.m_seeds
    s = _stream(entities, queries, request, settings, request.window)
    seeds = cut(s.passers.where(F.col("rank") <= m))
    budget = settings.graph_work_budget
    found, steps = reach(seeds.select("qid", F.col("id").alias("seed")), typed(g.live, request.edge_type), request.hops, budget)
    # seeds take their turns on one budget, the nearest first
    turn = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    took = steps.join(seeds.select("qid", F.col("id").alias("seed"), "rank"), ["qid", "seed"])
    took = cut(took.withColumn("left", F.lit(budget) - F.coalesce(F.sum("steps").over(turn), F.lit(0))))
    used = took.groupBy("qid").agg(F.least(F.sum("steps"), F.lit(budget)).alias("graph_examined"), (F.sum("steps") >= budget).alias("graph_censored"))
    members = found.join(took.select("qid", "seed", "left"), ["qid", "seed"]).where("depth = 0 or ord <= left").select("qid", F.col("vid").alias("id")).distinct()
    members = cut(members)
    streamed = s.passers.select("qid", "id", "dist", "rank")
    bridges = cut(_fetched(entities, queries, request, members))
    extra = used.join(bridges.groupBy("qid").agg(F.count("*").alias("bridges")), "qid", "left")
    # a stream without end has shown every accepted row, so only rejected members are fetched again
    endless = not (request.term_cond or settings.vector_scan_budget)
    fetched = members.join((bridges if endless else streamed).select("qid", "id"), ["qid", "id"], "left_anti").groupBy("qid").agg(F.count("*").alias("fetched"))
    extra = extra.join(fetched, "qid", "left")
    nearest = Window.partitionBy("qid").orderBy("dist", "id")
    bridge = bridges.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k).select("qid", "id", "dist", F.lit(True).alias("bridge"))
    winner = streamed.where(F.col("rank") <= k).select("qid", "id", "dist", F.lit(True).alias("winner"))
    pool = bridge.join(winner.select("qid", "id", "winner", F.col("dist").alias("wd")), ["qid", "id"], "full")
    pool = pool.select("qid", "id", F.coalesce("dist", "wd").alias("dist"), F.coalesce("bridge", F.lit(False)).alias("bridge"), F.when(F.col("winner"), 1).otherwise(2).alias("then"))
    return Answer(_emit(_fill(pool.withColumn("place", F.col("dist")), k), "dist"), _metrics(s.end, extra))


def by_pagerank(entities: DataFrame, g: Graph, queries: DataFrame, request: Request, settings: Settings = Settings()) -> Answer:
    """Seeds spread mass over the graph; near candidates and touched vertices compete by closeness plus mass, each scaled to 0..1."""
    k, m = request.k, request.m_seeds
    s = _stream(entities, queries, request, settings, request.window)
    seeds = cut(s.passers.where(F.col("rank") <= m).select("qid", F.col("id").alias("vid"), "dist", F.col("rank").alias("ord")))
    res = cut(push.reserves(seeds, typed(g.live, request.edge_type), request.hops, settings.ppr_alpha, settings.ppr_rmax, settings.graph_work_budget))
    used = res.groupBy("qid").agg(F.max("steps").alias("graph_examined"), F.max("censored").alias("graph_censored"))
    winner = s.passers.where(F.col("rank") <= k).select("qid", "id", "dist")
    touched = res.select("qid", F.col("vid").alias("id"), "reserve")
    others = cut(touched.join(winner.select("qid", "id"), ["qid", "id"], "left_anti"))
    fetched = cut(_fetched(entities, queries, request, others))
    pool = winner.join(touched, ["qid", "id"], "left").select("qid", "id", "dist", F.coalesce("reserve", F.lit(0.0)).alias("reserve"), F.col("reserve").isNotNull().alias("bridge"))
    pool = pool.unionByName(fetched.select("qid", "id", "dist", "reserve", F.lit(True).alias("bridge")))
    all_ = Window.partitionBy("qid")

    def scaled(x, low, high, value):
        return F.when(high > low, value / (high - low)).otherwise(1.0)

    lo, hi = F.min("dist").over(all_), F.max("dist").over(all_)
    rl, rh = F.min("reserve").over(all_), F.max("reserve").over(all_)
    score = scaled("dist", lo, hi, hi - F.col("dist")) + scaled("reserve", rl, rh, F.col("reserve") - rl)
    pool = cut(pool.withColumn("score", score))
    picked = _fill(pool.withColumn("place", -F.col("score")).withColumn("then", F.lit(1)), k, "score")
    extra = used.join(others.groupBy("qid").agg(F.count("*").alias("fetched")), "qid", "left").join(fetched.groupBy("qid").agg(F.count("*").alias("bridges")), "qid", "left")
    return Answer(_emit(picked, "score", "score"), _metrics(s.end, extra))


def tjs_open(entities: DataFrame, g: Graph, queries: DataFrame, request: Request, settings: Settings = Settings()) -> Answer:
    """One batch: with a column `src` anchored; else by seeds, or by vectors alone where m_seeds is 0."""
    if "src" in queries.columns:
        return anchored(entities, g, queries, request, settings)
    if not request.m_seeds:
        return vector_first(entities, queries, request, settings)
    run = membership if settings.graph_scoring == "membership" else by_pagerank
    return run(entities, g, queries, request, settings)


def one_hop(entities: DataFrame, g: Graph, queries: DataFrame, k: int, term_cond: int = 50, where: str = "", metric: str = "l2", join_order: str = "", attrs: list[str] | None = None) -> DataFrame:
    """The k nearest of a source's out-neighbours that pass a filter; queries without src use the filter alone.

    join_order picks how: '' and vector_first stream by distance and test, filter_first fetches the neighbours.
    The exact answer is the same; a term_cond of 0 stands for 50 and only bounds work, which here it need not.
    """
    if join_order not in ("", "vector_first", "filter_first"):
        raise ValueError("join_order must be '', vector_first or filter_first")
    request = Request(k=k, hops=1, where=where, metric=metric, m_seeds=0)
    no_graph = F.col("src").isNull() | (F.col("src") < 0)
    if join_order == "filter_first" and not queries.where(no_graph).isEmpty():
        raise ValueError("filter_first needs a source")
    rows = anchored(entities, g, queries.where(~no_graph), request).rows
    if join_order != "filter_first":
        rows = rows.unionByName(vector_first(entities, queries.where(no_graph), request).rows)
    return rows.join(entities.select("id", *attrs), "id") if attrs else rows
