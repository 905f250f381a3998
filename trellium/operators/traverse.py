"""Traversals: neighbours, bounded reach for batches of queries, degrees, shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellium.operators.graph_store import RELATED_TO, Graph
from trellium.storage import cut, if_small


def typed(edges: DataFrame, type_id: int | None) -> DataFrame:
    return edges.where(F.col("type_id") == type_id) if type_id else edges


def neighbours(g: Graph, sources: DataFrame | None = None, type_id: int | None = RELATED_TO, direction: int = 0, scope: int = -1) -> DataFrame:
    """(src, dst, ord): out-neighbours of sources(src), or of all, in insertion order, repeated edges kept.

    type None or 0 is any. Only direction 0 (out) exists here. A scope other than -1 keeps edges of that source alone.
    """
    if direction != 0:
        raise ValueError("only direction 0 can be followed")
    e = typed(g.live, type_id)
    if scope != -1:
        e = e.where(F.col("src") == scope)
    if sources is not None:
        e = e.join(sources.select("src").distinct(), "src", "left_semi")
    return e.select("src", "dst", F.row_number().over(Window.partitionBy("src").orderBy("seq")).cast("long").alias("ord"))


def neighbours_ext(g: Graph, sources: DataFrame, broadcast_map: bool = False) -> DataFrame:
    """(src, dst, ord) in external ids; an unmapped neighbour is a null dst."""
    if g.identity:
        return neighbours(g, sources)
    ids = if_small(g.ids, 32) if broadcast_map else g.ids
    inner = sources.select(F.col("src").alias("ext_id")).distinct().join(ids, "ext_id").select("ext_id", F.col("vid").alias("src"))
    found = neighbours(g, inner.select("src")).join(inner, "src")
    out = found.join(ids.select(F.col("ext_id").alias("ext_dst"), F.col("vid").alias("dst")), "dst", "left")
    return out.select(F.col("ext_id").alias("src"), F.col("ext_dst").alias("dst"), "ord")


def reach(starts: DataFrame, edges: DataFrame, hops: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """Breadth-first reach of starts(qid, seed) over edges(src, dst, seq): ((qid, seed, vid, depth, ord), (qid, seed, steps)).

    All queries advance together, one join a hop. Edges of a round are numbered by the rank of their source and
    their order there, after those of the rounds before: `ord` is the number of the edge that found a vertex, and
    a start stops at its budget of edges. The start itself is at depth 0 with ord 0.
    """
    starts = starts.select("qid", "seed").where("qid is not null and seed is not null").distinct()
    state = starts.select("qid", "seed", F.col("seed").alias("vid"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ord"))
    steps = starts.select("qid", "seed", F.lit(0).cast("long").alias("steps"))
    edges = edges.select("src", "dst", "seq")
    front = state
    for depth in range(1, hops + 1):
        by = Window.partitionBy("qid", "seed").orderBy("ord", "seq", "dst")
        e = front.join(edges, F.col("vid") == F.col("src")).join(steps, ["qid", "seed"]).where(F.col("steps") < budget)
        e = e.withColumn("step", F.col("steps") + F.row_number().over(by)).where(F.col("step") <= budget).select("qid", "seed", "dst", "step")
        e = cut(e)
        took = e.groupBy("qid", "seed").agg(F.max("step").alias("now"))
        steps = cut(steps.join(took, ["qid", "seed"], "left").select("qid", "seed", F.coalesce("now", "steps").alias("steps")))
        new = e.groupBy("qid", "seed", F.col("dst").alias("vid")).agg(F.min("step").alias("ord"))
        new = new.join(state.select("qid", "seed", "vid"), ["qid", "seed", "vid"], "left_anti")
        front = cut(new.select("qid", "seed", "vid", F.lit(depth).alias("depth"), "ord"))
        state = state.unionByName(front)
        if front.isEmpty():
            break
    return state, steps


def bounded(g: Graph, starts: DataFrame, max_depth: int, type_id: int | None = 0, budget: int = 65536) -> tuple[DataFrame, DataFrame]:
    """((qid, vid, depth, ord) without the starts, (qid, steps, censored)) of starts(qid, seed), one start a query.

    A traversal that uses its budget up counts as censored even if no edge was left.
    """
    if budget <= 0:
        raise ValueError("a budget must be positive")
    found, steps = reach(starts, typed(g.live, type_id), max_depth, budget)
    return found.where("depth > 0").drop("seed"), steps.select("qid", "steps", (F.col("steps") >= budget).alias("censored"))


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(qid, vid, depth): distinct vertices within max_depth of starts(qid, seed), the start itself left out. Order plays no part."""
    starts = starts.select("qid", "seed").where("qid is not null and seed is not null").distinct()
    front = starts.select("qid", F.col("seed").alias("vid"), F.lit(0).cast("long").alias("depth"))
    seen = front
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    for depth in range(1, max_depth + 1):
        new = front.join(edges, F.col("vid") == F.col("src")).select("qid", F.col("dst").alias("vid")).distinct()
        new = new.join(seen.select("qid", "vid"), ["qid", "vid"], "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        front = cut(new)
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return seen.where("depth > 0")


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("vid")).agg(F.count("*").alias("indeg"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once, without loops."""
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def hold_out(edges: DataFrame, held: DataFrame) -> DataFrame:
    """The undirected graph without the held edges, in either direction."""
    return undirected(edges).join(undirected(held), ["src", "dst"], "left_anti")


def in_neighbours(edges: DataFrame) -> DataFrame:
    """(vid, nbr): linked from nbr and not linking to it; mutual links count as out-links."""
    back = edges.select(F.col("dst").alias("vid"), F.col("src").alias("nbr")).where("vid <> nbr").distinct()
    return back.join(edges.select(F.col("src").alias("vid"), F.col("dst").alias("nbr")), ["vid", "nbr"], "left_anti")


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes of two sets and of their differences both ways."""
    a, b = a.distinct(), b.distinct()
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(a, "left_rows").crossJoin(one(b, "right_rows")).crossJoin(one(a.exceptAll(b), "only_left")).crossJoin(one(b.exceptAll(a), "only_right"))


def hop_distance(edges: DataFrame, pairs: DataFrame, max_hops: int = 6) -> DataFrame:
    """(a, b, hops) of pairs(a, b) over undirected edges; null where no path of max_hops exists.

    Both ends of all pairs advance in turn, and a pair leaves as soon as its two sides meet.
    """
    und = cut(undirected(edges))
    pairs = cut(pairs.select("a", "b").where("a is not null and b is not null").distinct())
    sides = {s: pairs.select("a", "b", F.col(s).alias("v"), F.lit(0).alias("d")) for s in ("a", "b")}
    fronts = dict(sides)
    met = cut(pairs.where("a = b").select("a", "b", F.lit(0).alias("hops")))
    open_ = pairs.where("a <> b")
    for hop in range(1, max_hops + 1):
        side, other = ("a", "b") if hop % 2 else ("b", "a")
        new = fronts[side].join(open_, ["a", "b"], "left_semi").join(und, F.col("v") == F.col("src")).select("a", "b", F.col("dst").alias("v")).distinct()
        new = cut(new.join(sides[side].select("a", "b", "v"), ["a", "b", "v"], "left_anti").withColumn("d", F.lit((hop + 1) // 2)))
        if new.isEmpty():
            break
        fronts[side] = new
        sides[side] = sides[side].unionByName(new)
        meet = new.join(sides[other].select("a", "b", "v", F.col("d").alias("e")), ["a", "b", "v"]).groupBy("a", "b").agg(F.min(F.col("d") + F.col("e")).alias("hops"))
        met = cut(met.unionByName(meet))
        open_ = cut(open_.join(met, ["a", "b"], "left_anti"))
        if open_.isEmpty():
            break
    return pairs.join(met, ["a", "b"], "left").select("a", "b", F.col("hops").cast("long").alias("hops"))


def connection_path(edges: DataFrame, a: int, b: int, max_hops: int = 6) -> list[int] | None:
    """One shortest undirected path from a to b, or None; [a] where both are the same.

    Distances from a are found outwards; the path is then walked back from b, one lookup a hop.
    """
    if a == b:
        return [a]
    spark = edges.sparkSession
    und = cut(undirected(edges))
    seen = spark.createDataFrame([(0, a, 0)], "qid int, vid long, depth long")
    found = bfs(und, spark.createDataFrame([(0, a)], "qid int, seed long"), max_hops)
    seen = cut(seen.unionByName(found))
    end = seen.where(F.col("vid") == b).first()
    if end is None:
        return None
    path, at = [b], b
    for d in range(end["depth"] - 1, -1, -1):
        at = und.where(F.col("src") == at).join(seen.where(F.col("depth") == d), F.col("dst") == F.col("vid")).agg(F.min("vid")).first()[0]
        path.append(at)
    return path[::-1]


def closure(edges: DataFrame, start: list[int], size: int, max_rounds: int = 64) -> DataFrame:
    """(vid, depth): vertices by distance from the start, and by id within one distance, until `size` are taken."""
    spark = edges.sparkSession
    edges = cut(edges.select("src", "dst").distinct())
    front = spark.createDataFrame([(v, 0) for v in sorted(set(start))], "vid long, depth int").orderBy("vid").limit(size)
    seen, n = front, min(size, len(set(start)))
    for d in range(1, max_rounds + 1):
        if n >= size:
            break
        new = front.join(edges, F.col("vid") == F.col("src")).select(F.col("dst").alias("vid")).distinct().join(seen.select("vid"), "vid", "left_anti")
        front = cut(new.orderBy("vid").limit(size - n).withColumn("depth", F.lit(d)))
        got = front.count()
        if not got:
            break
        seen, n = seen.unionByName(front), n + got
    return seen


def path_ends(edges: DataFrame, most: int) -> DataFrame:
    """(a, n): distinct ends of the paths from a along edges(src, dst), of `most` vertices; after its first edge none comes twice.

    One join a step: a recursive query stops at a number of rows that is set for the session.
    """
    e = edges.select("src", "dst").where("src is not null").distinct()
    paths = e.select(F.col("src").alias("a"), F.col("dst").alias("v"), F.array("src", "dst").alias("path"))
    ends = paths.select("a", "v")
    for _ in range(most - 2):
        paths = paths.join(e, F.col("v") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        paths = paths.select("a", F.col("dst").alias("v"), F.array_append("path", F.col("dst")).alias("path"))
        ends = ends.unionAll(paths.select("a", "v"))
    return ends.distinct().groupBy("a").agg(F.count("v").alias("n"))


def power_ppr(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, rounds: int = 20) -> DataFrame:
    """(qid, vid, rank): personalised PageRank of seeds(qid, vid, mass) after a fixed number of rounds.

    What a vertex without out-edges passes on is lost.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    links = cut(edges.join(out, "src").select("src", "dst", "deg"))
    start = cut(seeds.select("qid", "vid", F.col("mass").cast("double").alias("p")))
    rank = start
    for i in range(rounds):
        moved = rank.join(links, F.col("vid") == F.col("src")).groupBy("qid", F.col("dst").alias("vid")).agg(F.sum(F.col("p") / F.col("deg")).alias("m"))
        rank = moved.select("qid", "vid", (F.col("m") * (1 - alpha)).alias("p")).unionAll(start.select("qid", "vid", (F.col("p") * alpha).alias("p")))
        rank = rank.groupBy("qid", "vid").agg(F.sum("p").alias("p"))
        if i % 4 == 3:
            rank = cut(rank)
    return rank.withColumnRenamed("p", "rank")
