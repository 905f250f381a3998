"""Registered queries of the engine's own operators: name -> (query, SQL for DuckDB or None). Each runs over whole tables.

The test tables have no graph, so two are derived by formulas that Spark and SQL share: `edges` links every entity to six
others with three types; the star schema gives a second one, customer -> order -> part -> supplier -> nation -> region.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.functions import distance, sets, text
from trellium.operators import corpus, evaluate, fused, fusion, graph_store, links, packing, push, quantize, traverse, vector
from trellium.plans import graph_query, join_order
from trellium.settings import Request, Settings
from trellium.storage import cut
from trellium.streaming import edits as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ENT = "entities AS (SELECT vec_id AS id, coalesce(d.source, 'none') AS chunk, label AS ts, embedding FROM embeddings LEFT JOIN documents d ON vec_id = doc_id)"
EDGES = """edges AS (SELECT * FROM (SELECT vec_id AS src, (vec_id * 7 + j * j * 13 + j) % n AS dst, CAST(1 + (vec_id + j) % 3 AS INTEGER) AS type_id, CAST(j AS BIGINT) AS seq
  FROM embeddings, range(1, 7) AS t(j), (SELECT count(*) AS n FROM embeddings)) WHERE src <> dst)"""


def L2(a: str, b: str) -> str:  # noqa: N802
    return f"list_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def COS(a: str, b: str) -> str:  # noqa: N802
    return f"(1 - list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])))"


def IP(a: str, b: str) -> str:  # noqa: N802
    return f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def entities(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "source")
    e = read(spark, d, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"), "left")
    return e.select(F.col("vec_id").alias("id"), F.coalesce("source", F.lit("none")).alias("chunk"), F.col("label").alias("ts"), "embedding")


def edges(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "embeddings").select("vec_id")
    j = v.crossJoin(F.broadcast(v.agg(F.count("*").alias("n")))).withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(6))))
    e = j.select(
        F.col("vec_id").alias("src"),
        ((F.col("vec_id") * 7 + F.col("j") * F.col("j") * 13 + F.col("j")) % F.col("n")).alias("dst"),
        (1 + (F.col("vec_id") + F.col("j")) % 3).cast("int").alias("type_id"),
        F.col("j").cast("long").alias("seq"),
    )
    return e.where("src <> dst")


def graph(spark: SparkSession, d: str) -> graph_store.Graph:
    n = read(spark, d, "embeddings").count()
    return graph_store.from_edges(spark, edges(spark, d), n)


def all_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every entity as a query."""
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def shown(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in ("dist", "score", "cos") else c for c in cols])


# --- vectors ---------------------------------------------------------------------------------------------------------


@query(f"""SELECT qid, rank, id, round(dist, 6) AS dist FROM (SELECT qid, id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS BIGINT) AS rank FROM
  (SELECT a.vec_id AS qid, b.vec_id AS id, {COS("a.embedding", "b.embedding")} AS dist FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE rank <= 10""")
def vec_knn_self_join(spark, d):
    return shown(vector.knn(all_queries(spark, d), entities(spark, d), 10, "cosine", not_self=True), "qid", "rank", "id", "dist")


def _all_sql(d: str) -> str:
    return f"""SELECT qid, rank, id, round(dist, 6) AS dist FROM (SELECT qid, id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS BIGINT) AS rank FROM
      (SELECT a.vec_id AS qid, b.vec_id AS id, {d} AS dist FROM embeddings a, embeddings b)) WHERE rank <= 10"""


@query(_all_sql(L2("a.embedding", "b.embedding")))
def vec_l2_topk(spark, d):
    return shown(vector.knn(all_queries(spark, d), entities(spark, d), 10, "l2"), "qid", "rank", "id", "dist")


@query(_all_sql(COS("a.embedding", "b.embedding")))
def vec_cosine_topk(spark, d):
    return shown(vector.knn(all_queries(spark, d), entities(spark, d), 10, "cosine"), "qid", "rank", "id", "dist")


@query(_all_sql("-" + IP("a.embedding", "b.embedding")))
def vec_ip_topk(spark, d):
    return shown(vector.knn(all_queries(spark, d), entities(spark, d), 10, "ip"), "qid", "rank", "id", "dist")


@query(f"""SELECT CAST(t AS INTEGER) AS threshold, qid, rank, id, round(dist, 6) AS dist FROM (SELECT t, qid, id, dist, CAST(row_number() OVER (PARTITION BY t, qid ORDER BY dist, id) AS BIGINT) AS rank FROM
  (SELECT t, a.vec_id AS qid, b.vec_id AS id, {L2("a.embedding", "b.embedding")} AS dist FROM embeddings a, embeddings b, (VALUES (1), (5), (9)) AS s(t) WHERE b.label >= t)) WHERE rank <= 10""")
def vec_filtered_topk(spark, d):
    q, e = all_queries(spark, d), entities(spark, d)
    parts = [vector.knn(q, e.where(F.col("ts") >= t), 10).withColumn("threshold", F.lit(t)) for t in (1, 5, 9)]
    return shown(parts[0].unionByName(parts[1]).unionByName(parts[2]), "threshold", "qid", "rank", "id", "dist")


@query(f"SELECT a.vec_id AS qid, b.vec_id AS id FROM embeddings a, embeddings b WHERE {L2('a.embedding', 'b.embedding')} <= 1.3")
def vec_range(spark, d):
    return vector.within(all_queries(spark, d), entities(spark, d), 1.3).select("qid", "id")


@query(f"""WITH n AS (SELECT count(*) AS n FROM embeddings), q AS (SELECT a.vec_id AS qid, a.embedding AS q, b.embedding AS p FROM embeddings a, n, embeddings b WHERE b.vec_id = (a.vec_id + 4) % n)
  SELECT qid, rank, id, round(dist, 6) AS dist FROM (SELECT qid, id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS BIGINT) AS rank FROM
  (SELECT qid, vec_id AS id, 0.7 * {L2("embedding", "q")} + 0.3 * {L2("embedding", "p")} AS dist FROM q, embeddings)) WHERE rank <= 10""")
def vec_multi_topk(spark, d):
    v = read(spark, d, "embeddings")
    a = v.crossJoin(F.broadcast(v.agg(F.count("*").alias("n")))).select(F.col("vec_id").alias("qid"), "embedding", ((F.col("vec_id") + 4) % F.col("n")).alias("other"))
    q = a.join(v.select(F.col("vec_id").alias("other"), F.col("embedding").alias("p")), "other").select("qid", F.concat("embedding", "p").alias("qvec"))
    width = v.agg(F.max(F.size("embedding"))).first()[0]
    e = entities(spark, d).withColumn("embedding", F.concat("embedding", "embedding"))
    return shown(vector.weighted_knn(q, e, [(0.7, width), (0.3, width)], 10), "qid", "rank", "id", "dist")


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm FROM embeddings")
def vec_normalize(spark, d):
    e = read(spark, d, "embeddings").withColumn("twice", F.transform("embedding", lambda x: x * 2))
    n = distance.norm(distance.unit(F.col("twice")))
    return e.select(F.col("vec_id").alias("id"), F.round(n, 6).alias("norm"))


@query("""WITH p AS (SELECT a.vec_id AS qid, list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) + CAST(p[2] AS DOUBLE)) / 2) AS m
  FROM embeddings a, (SELECT count(*) AS n FROM embeddings), embeddings b WHERE b.vec_id = (a.vec_id + 1) % n)
  SELECT qid, round(m[1] / sqrt(list_sum(list_transform(m, lambda x: x * x))), 6) AS head FROM p""")
def vec_query_set(spark, d):
    v = read(spark, d, "embeddings")
    pairs = v.crossJoin(F.broadcast(v.agg(F.count("*").alias("n")))).select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("a"), ((F.col("vec_id") + 1) % F.col("n")).alias("b"))
    return vector.query_set(v.withColumnRenamed("vec_id", "id"), pairs).select("qid", F.round(F.element_at("qvec", 1), 6).alias("head"))


@query()
def vec_ivf_topk(spark, d):
    return shown(vector.ivf_knn(all_queries(spark, d), entities(spark, d), 10, lists=16, nprobe=12), "qid", "rank", "id", "dist")


@query()
def vec_rabitq_recall(spark, d):
    """Recall at 10 of codes of 1, 2, 4 and 8 bits, with and without an exact rerank of 100."""
    q, e = all_queries(spark, d), entities(spark, d)
    truth = cut(vector.knn(q, e, 10).groupBy("qid").agg(F.collect_set("id").alias("truth")))
    out = None
    for bits in (1, 2, 4, 8):
        book = quantize.fit(e, bits)
        near = cut(vector.knn(q, quantize.decode(quantize.encode(e, book), book), 100))
        raw = near.where("rank <= 10").groupBy("qid").agg(F.collect_set("id").alias("got"))
        again = fusion.rank_by_distance(e, q, near.select("qid", "id"), 10).groupBy("qid").agg(F.collect_set("id").alias("again"))
        r = truth.join(raw, "qid").join(again, "qid").agg(F.avg(sets.recall(F.col("got"), F.col("truth"))).alias("recall"), F.avg(sets.recall(F.col("again"), F.col("truth"))).alias("reranked"))
        # the offset keeps means that end in a 5 on one side of the border, whatever the order of the sums
        r = r.select(F.lit(bits).alias("bits"), F.round(F.col("recall") + 1e-11, 3).alias("recall"), F.round(F.col("reranked") + 1e-11, 3).alias("reranked"))
        out = r if out is None else out.unionByName(r)
    return out


# --- graph -----------------------------------------------------------------------------------------------------------


@query(f"WITH {EDGES} SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY seq) AS BIGINT) AS ord FROM edges WHERE type_id = 1")
def graph_neighbors(spark, d):
    return traverse.neighbours(graph(spark, d))


@query(f"WITH {EDGES} SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY seq) AS BIGINT) AS ord FROM edges WHERE type_id = 2")
def graph_typed(spark, d):
    return traverse.neighbours(graph(spark, d), type_id=2)


@query(f"""WITH {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges),
  a AS (SELECT src AS qid, dst AS vid, 1 AS depth FROM e UNION ALL SELECT x.src, y.dst, 2 FROM e x JOIN e y ON x.dst = y.src)
  SELECT qid, vid, CAST(min(depth) AS BIGINT) AS depth FROM a WHERE qid <> vid GROUP BY qid, vid""")
def graph_bfs_depth(spark, d):
    starts = read(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("seed"))
    return traverse.bfs(edges(spark, d), starts, 2)


@query(f"""WITH {EDGES}, h1 AS (SELECT src AS qid, dst, row_number() OVER (PARTITION BY src ORDER BY seq) AS step FROM edges),
  f1 AS (SELECT qid, dst AS vid, min(step) AS ord FROM h1 WHERE qid <> dst GROUP BY qid, dst), n1 AS (SELECT qid, max(step) AS s FROM h1 GROUP BY qid),
  h2 AS (SELECT f1.qid, edges.dst, s + row_number() OVER (PARTITION BY f1.qid ORDER BY f1.ord, seq) AS step FROM f1 JOIN n1 USING (qid) JOIN edges ON f1.vid = edges.src),
  c2 AS (SELECT * FROM h2 WHERE step <= 24),
  f2 AS (SELECT c2.qid, c2.dst AS vid, min(step) AS ord FROM c2 LEFT JOIN f1 ON c2.qid = f1.qid AND c2.dst = f1.vid WHERE f1.vid IS NULL AND c2.qid <> c2.dst GROUP BY c2.qid, c2.dst)
  SELECT qid, vid, CAST(1 AS BIGINT) AS depth, CAST(ord AS BIGINT) AS ord FROM f1 UNION ALL SELECT qid, vid, 2, CAST(ord AS BIGINT) FROM f2""")
def graph_bounded(spark, d):
    starts = read(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("seed"))
    found, _ = traverse.bounded(graph(spark, d), starts, 2, 0, 24)
    return found.select("qid", "vid", F.col("depth").cast("long").alias("depth"), F.col("ord").cast("long").alias("ord"))


@query(f"WITH {EDGES} SELECT dst AS vid, count(*) AS indeg FROM edges GROUP BY dst")
def graph_indegree(spark, d):
    return traverse.in_degree(edges(spark, d))


@query(f"""WITH {EDGES}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), h AS (SELECT src, dst FROM edges WHERE type_id = 3 UNION SELECT dst, src FROM edges WHERE type_id = 3)
  SELECT src, dst FROM u EXCEPT SELECT src, dst FROM h""")
def graph_symmetrise(spark, d):
    e = edges(spark, d)
    return traverse.hold_out(e, e.where("type_id = 3"))


@query(f"""WITH {EDGES}, gone AS (SELECT src, dst FROM edges WHERE type_id = 2), v AS (SELECT count(*) AS n FROM embeddings)
  SELECT (SELECT count(*) FROM embeddings WHERE label <> 9) AS vertex_count, (SELECT count(*) FROM edges) AS edge_count,
  (SELECT count(*) FROM edges e WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.src = e.src AND g.dst = e.dst) AND e.src NOT IN (SELECT vec_id FROM embeddings WHERE label = 9)) AS visible_edge_count, n AS allocated_vids FROM v""")
def graph_tombstone_counts(spark, d):
    g = graph(spark, d)
    g = graph_store.tombstone_edges(g, g.live.where("type_id = 2").select("src", "dst", F.lit(0).alias("type_id")))
    g = graph_store.tombstone_vertices(g, read(spark, d, "embeddings").where("label = 9").select(F.col("vec_id").alias("vid")))
    return graph_store.counts(g)


@query(f"WITH {EDGES} SELECT src * 3 + 1 AS src, CASE WHEN dst % 5 <> 0 THEN dst * 3 + 1 END AS dst, CAST(row_number() OVER (PARTITION BY src ORDER BY seq) AS BIGINT) AS ord FROM edges WHERE type_id = 1 AND src % 5 <> 0")
def graph_ext_neighbors(spark, d):
    from dataclasses import replace

    ids = read(spark, d, "embeddings").select((F.col("vec_id") * 3 + 1).alias("ext_id"), F.col("vec_id").alias("vid")).where("vid % 5 <> 0")
    g = replace(graph(spark, d), ids=ids, identity=False)
    return traverse.neighbours_ext(g, ids.select(F.col("ext_id").alias("src")))


@query(f"WITH {EDGES} SELECT src, dst, type_id FROM edges")
def graph_dump_edges(spark, d):
    return graph_store.dump_edges(graph(spark, d))


@query(f"WITH {EDGES} SELECT src AS vid, CAST(count(*) AS BIGINT) AS degree, list_aggregate(list(dst ORDER BY seq), 'string_agg', ',') AS nbrs FROM edges GROUP BY src")
def graph_adjacency(spark, d):
    a = graph_store.adjacency(graph(spark, d))
    return a.select("vid", F.size("nbrs").cast("long").alias("degree"), F.array_join(F.col("nbrs").cast("array<string>"), ",").alias("nbrs"))


@query(f"""WITH {EDGES}, log AS (SELECT src % 4 AS txn, 'insert' AS op, src, dst, type_id, seq FROM edges UNION ALL SELECT 4 + dst % 2, 'delete', src, dst, type_id, seq FROM edges WHERE seq = 2)
  SELECT src, dst, type_id, seq FROM edges WHERE src % 4 <> 3 AND NOT (seq = 2 AND dst % 2 = 0)""")
def graph_visible_log(spark, d):
    e = edges(spark, d)
    ins = e.select((F.col("src") % 4).alias("txn"), F.lit("insert").alias("op"), "src", "dst", "type_id", "seq")
    gone = e.where("seq = 2").select((F.col("dst") % 2 + 4).alias("txn"), F.lit("delete").alias("op"), "src", "dst", "type_id", "seq")
    txns = spark.createDataFrame([(i, i not in (3, 5)) for i in range(6)], "txn long, committed boolean")
    return graph_store.visible(ins.unionByName(gone), txns)


@query(f"""WITH {EDGES}, u AS (SELECT DISTINCT src AS vid, dst AS nbr FROM edges) SELECT nbr AS vid, vid AS nbr FROM u EXCEPT SELECT vid, nbr FROM u""")
def graph_in_neighbors(spark, d):
    return traverse.in_neighbours(edges(spark, d))


@query(f"""WITH RECURSIVE {EDGES}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), n AS (SELECT count(*) AS n FROM embeddings),
  p AS (SELECT vec_id AS a, (vec_id * 31 + 17) % n AS b FROM embeddings, n),
  r AS (SELECT a, b, a AS v, 0 AS h FROM p UNION SELECT a, b, u.dst, h + 1 FROM r JOIN u ON r.v = u.src WHERE h < 6)
  SELECT p.a, p.b, CAST(min(h) AS BIGINT) AS hops FROM p LEFT JOIN r ON p.a = r.a AND p.b = r.b AND r.v = p.b GROUP BY p.a, p.b""")
def graph_hop_distance(spark, d):
    v = read(spark, d, "embeddings")
    pairs = v.crossJoin(F.broadcast(v.agg(F.count("*").alias("n")))).select(F.col("vec_id").alias("a"), ((F.col("vec_id") * 31 + 17) % F.col("n")).alias("b"))
    return traverse.hop_distance(edges(spark, d), pairs)


@query(f"""WITH {EDGES}, a AS (SELECT DISTINCT src, dst FROM edges WHERE type_id <> 1), b AS (SELECT DISTINCT src, dst FROM edges WHERE type_id <> 2)
  SELECT (SELECT count(*) FROM a) AS left_rows, (SELECT count(*) FROM b) AS right_rows, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_right""")
def graph_reach_parity(spark, d):
    e = edges(spark, d)
    return traverse.parity(e.where("type_id <> 1").select("src", "dst"), e.where("type_id <> 2").select("src", "dst"))


def _power_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT vec_id AS qid, vec_id AS vid, CAST(1.0 AS DOUBLE) AS p FROM embeddings)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"""r{i} AS (SELECT qid, vid, sum(p) AS p FROM (SELECT qid, l.dst AS vid, 0.85 * p / deg AS p FROM r{i - 1} JOIN l ON vid = l.src
            UNION ALL SELECT qid, vid, 0.15 * p FROM r0) GROUP BY qid, vid)"""
        )
    return f"WITH {EDGES}, o AS (SELECT src, count(*) AS deg FROM edges GROUP BY src), l AS (SELECT e.src, e.dst, deg FROM edges e JOIN o USING (src)), {', '.join(steps)} SELECT qid, vid, round(p + 1e-11, 6) AS rank FROM r{rounds}"


@query(_power_sql(3))
def graph_ppr_power(spark, d):
    seeds = read(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("vid"), F.lit(1.0).alias("mass"))
    # the offset keeps ranks that end in a 5 on one side of the border, whatever the order of the sums
    return traverse.power_ppr(edges(spark, d), seeds, 0.15, 3).select("qid", "vid", F.round(F.col("rank") + 1e-11, 6).alias("rank"))


@query()
def graph_ppr_push(spark, d):
    seeds = read(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("vid"), F.lit(0.0).alias("dist"), F.lit(1).alias("ord"))
    return push.reserves(seeds, edges(spark, d), 3, 0.15, 1e-3, 65536).withColumn("reserve", F.round("reserve", 9))


@query(f"""WITH {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges), r AS (SELECT CAST(0 AS BIGINT) AS vid, 0 AS depth UNION ALL SELECT dst, 1 FROM e WHERE src = 0
  UNION ALL SELECT y.dst, 2 FROM e x JOIN e y ON x.dst = y.src WHERE x.src = 0 UNION ALL SELECT z.dst, 3 FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src WHERE x.src = 0)
  SELECT vid, CAST(depth AS BIGINT) AS depth FROM (SELECT vid, min(depth) AS depth FROM r GROUP BY vid) ORDER BY depth, vid LIMIT 20""")
def graph_closure(spark, d):
    return traverse.closure(edges(spark, d), [0], 20).select("vid", F.col("depth").cast("long").alias("depth"))


@query("""SELECT 'customer_order' AS kind, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) UNION ALL SELECT 'order_part', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
  UNION ALL SELECT 'part_supplier', count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) UNION ALL SELECT 'supplier_nation', count(*) FROM supplier UNION ALL SELECT 'nation_region', count(*) FROM nation""")
def graph_fk_edges(spark, d):
    line = read(spark, d, "lineitem")
    parts = {
        "customer_order": read(spark, d, "orders").select("o_custkey", "o_orderkey"),
        "order_part": line.select("l_orderkey", "l_partkey"),
        "part_supplier": line.select("l_partkey", "l_suppkey"),
        "supplier_nation": read(spark, d, "supplier").select("s_suppkey", "s_nationkey"),
        "nation_region": read(spark, d, "nation").select("n_nationkey", "n_regionkey"),
    }
    out = None
    for kind, df in parts.items():
        n = df.distinct().agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("""SELECT o_custkey AS c_custkey, count(DISTINCT s_nationkey) AS nations, count(DISTINCT l_suppkey) AS suppliers
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY o_custkey""")
def graph_fk_reach(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey")
    p = o.join(read(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct()
    p = p.join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return p.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("s_nationkey").alias("nations"), F.count("*").alias("suppliers"))


@query(f"""WITH {EDGES}, n AS (SELECT src, count(*) AS degree FROM edges GROUP BY src) SELECT src, CAST(degree AS BIGINT) AS degree, CAST(ceil(degree / 1022.0) AS BIGINT) AS pages,
  CAST(least(degree, 4) AS BIGINT) AS delta_tail, CAST(degree - least(degree, 4) AS BIGINT) AS sorted_run, degree >= 6 AS is_hub, CAST(32768 AS BIGINT) AS image_bytes FROM n""")
def graph_packing(spark, d):
    n = edges(spark, d).groupBy("src").agg(F.count("*").alias("degree"))
    return packing.layout(n, tail_cap=4, hub_from=6)


# --- fused -----------------------------------------------------------------------------------------------------------

REACH2 = """e AS (SELECT DISTINCT src, dst FROM edges), reach AS (SELECT DISTINCT qid, vid FROM (SELECT src AS qid, dst AS vid FROM e UNION SELECT x.src, y.dst FROM e x JOIN e y ON x.dst = y.src) WHERE qid <> vid)"""


@query(f"""WITH {EDGES}, {REACH2} SELECT qid, rank, id, round(dist, 6) AS dist FROM (SELECT qid, id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS BIGINT) AS rank FROM
  (SELECT qid, vid AS id, {L2("a.embedding", "b.embedding")} AS dist FROM reach JOIN embeddings a ON qid = a.vec_id JOIN embeddings b ON vid = b.vec_id)) WHERE rank <= 10""")
def fused_anchored(spark, d):
    q = all_queries(spark, d).withColumn("src", F.col("qid"))
    return shown(fused.tjs_open(entities(spark, d), graph(spark, d), q, Request(k=10)).rows, "qid", "rank", "id", "dist")


@query(f"""WITH {EDGES}, {ENT} SELECT qid, rank, id, round(dist, 6) AS dist FROM (SELECT qid, id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS BIGINT) AS rank FROM
  (SELECT e.src AS qid, b.id, {COS("a.embedding", "b.embedding")} AS dist FROM (SELECT DISTINCT src, dst FROM edges WHERE type_id = 1) e JOIN embeddings a ON e.src = a.vec_id JOIN entities b ON e.dst = b.id WHERE b.ts < 5)) WHERE rank <= 3""")
def fused_anchored_typed(spark, d):
    q = all_queries(spark, d).withColumn("src", F.col("qid"))
    return shown(fused.tjs_open(entities(spark, d), graph(spark, d), q, Request(k=3, hops=1, edge_type=1, metric="cosine", where="ts < 5")).rows, "qid", "rank", "id", "dist")


@query()
def fused_filter_first_term_cond(spark, d):
    q = all_queries(spark, d).withColumn("src", F.col("qid"))
    return shown(fused.tjs_open(entities(spark, d), graph(spark, d), q, Request(k=5, term_cond=4)).rows, "qid", "rank", "id", "dist")


STREAM = f"s AS (SELECT a.vec_id AS qid, b.vec_id AS id, b.label AS ts, {L2('a.embedding', 'b.embedding')} AS dist FROM embeddings a, embeddings b), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rn FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS p FROM n WHERE ts < 5)"


@query(f"WITH {STREAM} SELECT qid, CAST(p AS BIGINT) AS rank, id, round(dist, 6) AS dist FROM p WHERE p <= 10")
def fused_vector_first(spark, d):
    a = fused.tjs_open(entities(spark, d), graph(spark, d), all_queries(spark, d), Request(k=10, m_seeds=0, where="ts < 5"))
    return shown(a.rows, "qid", "rank", "id", "dist")


@query(f"WITH {STREAM} SELECT qid, CAST(max(rn) FILTER (p = 26) AS BIGINT) AS examined, 'term_cond' AS termination_reason, FALSE AS budget_capped FROM p GROUP BY qid")
def fused_vector_first_metrics(spark, d):
    a = fused.tjs_open(entities(spark, d), graph(spark, d), all_queries(spark, d), Request(k=10, term_cond=16, m_seeds=0, where="ts < 5"))
    return a.metrics.select("qid", "examined", "termination_reason", "budget_capped")


MEMBERS = f"""{EDGES}, {STREAM}, seeds AS (SELECT qid, id FROM p WHERE p <= 4), e AS (SELECT DISTINCT src, dst FROM edges), m AS (SELECT qid, id FROM seeds UNION SELECT qid, dst FROM seeds JOIN e ON id = src),
  b AS (SELECT n.qid, n.id, n.dist, row_number() OVER (PARTITION BY n.qid ORDER BY n.dist, n.id) AS r FROM n JOIN m ON n.qid = m.qid AND n.id = m.id WHERE n.ts < 5),
  w AS (SELECT qid, id, dist FROM p WHERE p <= 10)"""


@query(f"""WITH {MEMBERS}, c AS (SELECT qid, id, dist, 0 AS leg FROM b WHERE r <= 5 UNION ALL SELECT qid, id, dist, 1 FROM w UNION ALL SELECT qid, id, dist, 2 FROM b WHERE r > 5 AND r <= 10),
  f AS (SELECT qid, id, min(leg) AS leg, any_value(dist) AS dist FROM c GROUP BY qid, id), g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY leg, dist, id) AS r FROM f)
  SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS BIGINT) AS rank, id, round(dist, 6) AS dist FROM g WHERE r <= 10""")
def fused_seedless_membership(spark, d):
    r = Request(k=10, term_cond=64, m_seeds=4, hops=1, where="ts < 5")
    return shown(fused.tjs_open(entities(spark, d), graph(spark, d), all_queries(spark, d), r, Settings(graph_scoring="membership")).rows, "qid", "rank", "id", "dist")


@query(f"""WITH {MEMBERS}, x AS (SELECT qid, max(rn) FILTER (p = 100) AS x FROM p GROUP BY qid),
  f AS (SELECT m.qid, count(*) FILTER (p.id IS NULL OR p.p > 100) AS fetched FROM m LEFT JOIN p ON m.qid = p.qid AND m.id = p.id GROUP BY m.qid),
  g AS (SELECT qid, count(*) AS g FROM seeds JOIN edges ON id = src GROUP BY qid), k AS (SELECT qid, count(*) AS k FROM b GROUP BY qid)
  SELECT qid, CAST(coalesce(x, (SELECT count(*) FROM embeddings)) + fetched AS BIGINT) AS examined, k AS bridges, g AS graph_examined FROM x JOIN f USING (qid) JOIN g USING (qid) JOIN k USING (qid)""")
def fused_membership_metrics(spark, d):
    r = Request(k=10, term_cond=64, m_seeds=4, hops=1, where="ts < 5")
    a = fused.tjs_open(entities(spark, d), graph(spark, d), all_queries(spark, d), r, Settings(graph_scoring="membership"))
    return a.metrics.select("qid", "examined", "bridges", "graph_examined")


@query()
def fused_seedless_ppr(spark, d):
    a = fused.tjs_open(entities(spark, d), graph(spark, d), all_queries(spark, d), Request(k=10, term_cond=64))
    return shown(a.rows, "qid", "rank", "id", "score")


@query(f"""WITH {EDGES}, {ENT} SELECT qid, rank, id, chunk, round(dist, 6) AS dist FROM (SELECT qid, id, chunk, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS BIGINT) AS rank FROM
  (SELECT e.src AS qid, b.id, b.chunk, {L2("a.embedding", "b.embedding")} AS dist FROM (SELECT DISTINCT src, dst FROM edges) e JOIN embeddings a ON e.src = a.vec_id JOIN entities b ON e.dst = b.id WHERE b.ts >= 5)) WHERE rank <= 3""")
def fused_one_hop(spark, d):
    q = all_queries(spark, d).withColumn("src", F.col("qid"))
    return shown(fused.one_hop(entities(spark, d), graph(spark, d), q, 3, where="ts >= 5", join_order="filter_first", attrs=["chunk"]), "qid", "rank", "id", "chunk", "dist")


@query(f"""WITH {EDGES}, {ENT} SELECT qid, rank, id, round(dist, 6) AS dist FROM (SELECT qid, id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS BIGINT) AS rank FROM
  (SELECT e.src AS qid, b.id, {L2("a.embedding", "b.embedding")} AS dist FROM (SELECT DISTINCT src, dst FROM edges) e JOIN embeddings a ON e.src = a.vec_id JOIN entities b ON e.dst = b.id WHERE list_contains([b.ts, b.id % 7], 3))) WHERE rank <= 5""")
def fused_type_containment(spark, d):
    e = entities(spark, d).withColumn("tags", F.array("ts", (F.col("id") % 7).cast("int")))
    q = all_queries(spark, d).withColumn("src", F.col("qid"))
    return shown(fused.tjs_open(e, graph(spark, d), q, Request(k=5, hops=1, where="tags @> ARRAY[3]")).rows, "qid", "rank", "id", "dist")


_CANON_TS = (1, 2, 3, 4, 5, 6)


@query(f"""WITH {EDGES}, {ENT} SELECT CAST(row_number() OVER (ORDER BY dist, id) AS BIGINT) AS rank, id, chunk FROM (SELECT b.id, b.chunk, {L2("a.embedding", "b.embedding")} AS dist
  FROM (SELECT DISTINCT src, dst FROM edges WHERE type_id = 1 AND src = 2) e JOIN embeddings a ON a.vec_id = 2 JOIN entities b ON e.dst = b.id WHERE b.ts IN {_CANON_TS}) ORDER BY dist, id LIMIT 5""")
def canonical_query(spark, d):
    v = ",".join(repr(float(x)) for x in read(spark, d, "embeddings").where("vec_id = 2").first()["embedding"])
    q = f"""SELECT gt.chunk FROM GRAPH_TABLE (entity_graph MATCH (a IS entity WHERE a.id = 2) -[IS related_to]-> (b IS entity)
      WHERE b.timestamp IN ({",".join(map(str, _CANON_TS))}) COLUMNS (b.chunk, b.embedding)) gt ORDER BY gt.embedding <-> '[{v}]' LIMIT 5"""
    return graph_query.graph_query(spark, q, entities(spark, d), graph(spark, d)).rows


@query(f"""WITH {EDGES}, {ENT}, s AS (SELECT a.vec_id AS qid, b.vec_id AS src, row_number() OVER (PARTITION BY a.vec_id ORDER BY {L2("a.embedding", "b.embedding")}, b.vec_id) AS sr FROM embeddings a, embeddings b),
  f AS (SELECT qid, e.dst AS id, min((sr, seq)) AS place FROM s JOIN edges e USING (src) JOIN entities t ON e.dst = t.id WHERE t.ts < 5 GROUP BY qid, e.dst)
  SELECT qid, id, rank FROM (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY place, id) AS BIGINT) AS rank FROM f) WHERE rank <= 10""")
def canonical_src_ranked(spark, d):
    return fusion.source_ranked(entities(spark, d), edges(spark, d), all_queries(spark, d), F.col("ts") < 5, 10)


@query(f"""WITH {EDGES}, s AS (SELECT a.vec_id AS qid, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {L2("a.embedding", "b.embedding")}, b.vec_id) AS r FROM embeddings a, embeddings b),
  m AS (SELECT qid, id FROM s WHERE r <= 4 UNION SELECT qid, dst FROM s JOIN edges ON id = src WHERE r <= 4)
  SELECT qid, rank, id, round(dist, 6) AS dist FROM (SELECT qid, id, dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS BIGINT) AS rank FROM
  (SELECT qid, id, {L2("a.embedding", "b.embedding")} AS dist FROM m JOIN embeddings a ON qid = a.vec_id JOIN embeddings b ON id = b.vec_id)) WHERE rank <= 10""")
def compose_blocking(spark, d):
    return shown(fusion.blocking(entities(spark, d), edges(spark, d), all_queries(spark, d), 4, 10), "qid", "rank", "id", "dist")


RANKS = f"""v AS (SELECT a.vec_id AS qid, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {L2("a.embedding", "b.embedding")}, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
  g AS (SELECT src AS qid, dst AS id, min(seq) AS rank FROM edges GROUP BY src, dst)"""


@query(f"""WITH {EDGES}, {RANKS} SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS BIGINT) AS rank FROM
  (SELECT qid, id, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + g.rank), 0) AS score FROM (SELECT * FROM v WHERE rank <= 20) v FULL JOIN g USING (qid, id))) WHERE rank <= 10""")
def rrf_fuse(spark, d):
    v = vector.knn(all_queries(spark, d), entities(spark, d), 20, not_self=True)
    g = edges(spark, d).groupBy(F.col("src").alias("qid"), F.col("dst").alias("id")).agg(F.min("seq").alias("rank"))
    return shown(fusion.rrf(v, g, 10), "qid", "id", "score", "rank")


@query(f"""WITH {EDGES}, {RANKS} SELECT qid, id, round(score, 6) AS score, rank FROM (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS BIGINT) AS rank FROM
  (SELECT qid, id, coalesce(1.0::DOUBLE / v.rank, 0) + coalesce(0.9::DOUBLE / (g.rank + 0.5), 0) AS score FROM (SELECT * FROM v WHERE rank <= 20) v FULL JOIN g USING (qid, id))) WHERE rank <= 10""")
def nra_sum_merge(spark, d):
    v = vector.knn(all_queries(spark, d), entities(spark, d), 20, not_self=True).select("qid", "id", (F.lit(1.0) / F.col("rank")).alias("score"))
    g = edges(spark, d).groupBy(F.col("src").alias("qid"), F.col("dst").alias("id")).agg((F.lit(0.9) / (F.min("seq") + 0.5)).alias("score"))
    return shown(fusion.sum_merge(v, g, 10), "qid", "id", "score", "rank")


@query()
def nra_bounded_merge(spark, d):
    v = vector.knn(all_queries(spark, d), entities(spark, d), 20, not_self=True).select("qid", "id", (F.lit(1.0) / F.col("rank")).alias("score"))
    g = edges(spark, d).groupBy(F.col("src").alias("qid"), F.col("dst").alias("id")).agg((F.lit(0.9) / (F.min("seq") + 0.5)).alias("score"))
    return fusion.bounded_merge_batch(v, g, 5)


@query()
def drops_merge(spark, d):
    v = vector.knn(all_queries(spark, d), entities(spark, d), 40, not_self=True).select("qid", "id", (-F.col("dist")).alias("score"), F.pmod(F.xxhash64("qid", "id"), F.lit(1 << 30)).alias("ord"))
    return fusion.drops_merge(v, 5, 8)


@query(f"""WITH {EDGES}, {RANKS}, c AS (SELECT qid, id, 0 AS leg, rank FROM v WHERE rank <= 3 UNION ALL SELECT qid, id, 1, rank FROM g UNION ALL SELECT qid, id, 2, rank FROM v WHERE rank <= 20),
  f AS (SELECT qid, id, min((leg, rank)) AS place FROM c GROUP BY qid, id)
  SELECT qid, id, rank FROM (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY place, id) AS BIGINT) AS rank FROM f) WHERE rank <= 8""")
def graph_inject(spark, d):
    v = vector.knn(all_queries(spark, d), entities(spark, d), 20, not_self=True)
    g = edges(spark, d).groupBy(F.col("src").alias("qid"), F.col("dst").alias("id")).agg(F.min("seq").alias("rank"))
    return fusion.injected(v.where("rank <= 3"), g, v, 8)


@query(f"""WITH {EDGES}, {ENT}, i AS (SELECT dst AS id, count(*) AS indeg FROM edges GROUP BY dst), s AS (SELECT a.vec_id AS qid, b.vec_id AS id, {COS("a.embedding", "b.embedding")} AS dist FROM embeddings a, embeddings b),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS BIGINT) AS rank FROM s)
  SELECT qid, id, round(dist, 6) AS dist, rank, coalesce(indeg, 0) AS indeg FROM r JOIN entities e USING (id) LEFT JOIN i USING (id) WHERE rank <= 150 AND coalesce(indeg, 0) >= 6 AND e.ts < 5""")
def semantic_search(spark, d):
    r = fusion.semantic_search(entities(spark, d), edges(spark, d), all_queries(spark, d), 150, (F.col("indeg") >= 6) & (F.col("ts") < 5))
    return shown(r, "qid", "id", "dist", "rank", "indeg")


@query(f"""WITH {EDGES}, s AS MATERIALIZED (SELECT a.vec_id AS qid, b.vec_id AS id, {COS("a.embedding", "b.embedding")} AS dist FROM embeddings a, embeddings b),
  seeds AS MATERIALIZED (SELECT qid, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS r FROM s) WHERE r <= 40),
  o AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM (SELECT DISTINCT src, dst FROM edges)) WHERE r <= 200),
  a AS MATERIALIZED (SELECT qid, dst AS id, count(*) AS hits FROM seeds JOIN o ON id = src GROUP BY qid, dst),
  h AS MATERIALIZED (SELECT a.* FROM a ANTI JOIN seeds USING (qid, id)),
  most AS (SELECT qid, max(hits) AS most FROM h GROUP BY qid), l AS (SELECT qid, id, hits FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, id) AS r FROM h) WHERE r <= 150),
  c AS MATERIALIZED (SELECT qid, id, 0 AS hits, 'meaning' AS prov FROM seeds UNION ALL SELECT qid, id, hits, 'linked' FROM l)
  SELECT c.qid, c.id, CAST(c.hits AS BIGINT) AS hits, prov, round((1 - dist) + 0.25 * coalesce(c.hits / most, 0), 6) AS score FROM c JOIN s ON c.qid = s.qid AND c.id = s.id LEFT JOIN most ON c.qid = most.qid""")
def trimodal_search(spark, d):
    r = fusion.trimodal(entities(spark, d), edges(spark, d), all_queries(spark, d), seed=40, pool=150)
    return r.select("qid", "id", "hits", "prov", F.round("score", 6).alias("score"))


@query(f"""WITH {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges), s AS (SELECT a.vec_id AS qid, b.vec_id AS id, {COS("a.embedding", "b.embedding")} AS dist FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
  cr AS (SELECT qid, id, r - 1 AS cr FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS r FROM s) WHERE r <= 50),
  d1 AS (SELECT src AS qid, dst AS id, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS gr FROM e), deg AS (SELECT qid, count(*) AS deg FROM d1 GROUP BY qid),
  d2 AS (SELECT d1.qid, e.dst AS id, count(*) AS n FROM d1 JOIN e ON d1.id = e.src WHERE e.dst <> d1.qid AND NOT EXISTS (SELECT 1 FROM d1 z WHERE z.qid = d1.qid AND z.id = e.dst) GROUP BY d1.qid, e.dst),
  t AS (SELECT qid, id, deg + r - 1 AS gr FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, id) AS r FROM d2) JOIN deg USING (qid) WHERE r <= 50),
  g AS (SELECT qid, id, gr, 1 AS hop FROM d1 UNION ALL SELECT qid, id, gr, 2 FROM t),
  f AS (SELECT qid, id, coalesce(1.0::DOUBLE / (60 + cr), 0) + coalesce(1.0::DOUBLE / (60 + gr), 0) AS score, CASE WHEN cr IS NOT NULL AND hop = 1 THEN 'meaning + linked' WHEN cr IS NOT NULL THEN 'meaning only' WHEN hop = 1 THEN 'linked (1-hop)' ELSE 'linked (2-hop)' END AS prov FROM cr FULL JOIN g USING (qid, id))
  SELECT qid, id, round(score, 6) AS score, prov, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS BIGINT) AS rank FROM f) WHERE rank <= 15""")
def related_fused(spark, d):
    return shown(fusion.related(entities(spark, d), edges(spark, d), all_queries(spark, d)), "qid", "id", "score", "prov", "rank")


@query(f"""WITH {EDGES}, s AS MATERIALIZED (SELECT a.vec_id AS qid, b.vec_id AS id, {COS("a.embedding", "b.embedding")} AS dist FROM embeddings a, embeddings b),
  n AS MATERIALIZED (SELECT qid, id, r FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS r FROM s) WHERE r <= 6),
  l AS (SELECT qid, dst AS id, arg_min(src, r) AS via FROM n JOIN (SELECT DISTINCT src, dst FROM edges) ON id = src GROUP BY qid, dst),
  x AS MATERIALIZED (SELECT l.* FROM l ANTI JOIN n USING (qid, id)),
  y AS (SELECT x.qid, x.id, via, row_number() OVER (PARTITION BY x.qid ORDER BY dist, x.id) AS r FROM x JOIN s ON x.qid = s.qid AND x.id = s.id)
  SELECT qid, id, CAST(NULL AS BIGINT) AS via, CAST(r AS BIGINT) AS rank FROM n UNION ALL SELECT qid, id, via, CAST(r + 6 AS BIGINT) FROM y WHERE r <= 6""")
def ask_expand(spark, d):
    return fusion.via_seeds(entities(spark, d), edges(spark, d), all_queries(spark, d))


# --- planner ---------------------------------------------------------------------------------------------------------

_LABELS = "WITH m AS (SELECT label, count(*) AS matches FROM embeddings GROUP BY label), n AS (SELECT count(*) AS size FROM embeddings)"


def _stats(spark, d):
    e = read(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("matches")).crossJoin(F.broadcast(e.agg(F.count("*").alias("size"))))


@query(f"{_LABELS} SELECT label, matches, CASE WHEN matches / size <= 0.1 THEN 'filter_first' ELSE 'vector_first' END AS choice FROM m, n")
def join_order_threshold(spark, d):
    return _stats(spark, d).select("label", "matches", join_order.threshold_column(F.col("matches"), F.col("size")).alias("choice"))


@query(f"""{_LABELS} SELECT label, CAST(deg AS BIGINT) AS deg, CASE WHEN deg * (matches / size) <= 4.0 * least(5 / (matches / size * deg / size), size) THEN 'filter_first' ELSE 'vector_first' END AS choice
  FROM m, n, (VALUES (4), (60), (300), (100000)) AS t(deg)""")
def join_order_cost(spark, d):
    s = _stats(spark, d).withColumn("deg", F.explode(F.array(*[F.lit(x).cast("long") for x in (4, 60, 300, 100000)])))
    return s.select("label", "deg", join_order.cost_column(F.col("deg"), F.col("matches"), F.col("size"), F.lit(5)).alias("choice"))


@query(f"{_LABELS} SELECT label, CAST(least(matches, 20) AS BIGINT) AS filter_rows, CAST(1000 AS BIGINT) AS vector_rows, round(matches / size, 6) AS sel FROM m, n")
def join_order_estimates(spark, d):
    return _stats(spark, d).select("label", F.least("matches", F.lit(20)).cast("long").alias("filter_rows"), F.lit(join_order.intermediate(1, 20, "vector_first")).cast("long").alias("vector_rows"), F.round(F.col("matches") / F.col("size"), 6).alias("sel"))


# --- relational ------------------------------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 1""")
def rel_pricing_summary(spark, d):
    li = read(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    g = li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("n"),
    )
    return g.where("n > 1")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def rel_semi_anti(spark, d):
    o = read(spark, d, "orders")
    c = read(spark, d, "customer").join(o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return c.join(o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""(SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal < 0 AND c_mktsegment LIKE '%B%'""")
def rel_set_ops(spark, d):
    a = read(spark, d, "nation").select(F.col("n_nationkey").alias("k")).union(read(spark, d, "supplier").select("s_nationkey")).distinct()
    return a.exceptAll(read(spark, d, "customer").where("c_acctbal < 0 and c_mktsegment like '%B%'").select("c_nationkey").distinct())


@query("""SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, count(DISTINCT n_nationkey) AS n FROM nation GROUP BY n_regionkey""")
def rel_string_agg(spark, d):
    return read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"), F.count_distinct("n_nationkey").alias("n"))


@query(f"""WITH RECURSIVE {EDGES}, w AS (SELECT src AS a, dst AS v, [src, dst] AS path FROM edges WHERE type_id = 1 UNION ALL SELECT a, e.dst, list_append(path, e.dst) FROM w JOIN edges e ON w.v = e.src
  WHERE e.type_id = 1 AND NOT list_contains(path, e.dst) AND len(path) < 4) SELECT a, count(DISTINCT v) AS n FROM w GROUP BY a""")
def rel_recursive_paths(spark, d):
    return traverse.path_ends(edges(spark, d).where("type_id = 1"), 4)


@query("""SELECT c_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)""")
def rel_lateral_top(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("m"))
    c = read(spark, d, "customer").select("c_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", (-F.col("m.k")).alias("o_orderkey"), F.round("m.o_totalprice", 2).alias("price"))


@query("""SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def rel_upsert_latest(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN value IS NULL THEN 'none' WHEN value BETWEEN 1 AND 10 THEN 'low' ELSE 'high' END AS band FROM events WHERE event_type IN ('click', 'view') OR value > 50""")
def rel_filters_json(spark, d):
    e = read(spark, d, "events").where("event_type in ('click', 'view') or value > 50")
    band = F.when(F.col("value").isNull(), "none").when(F.col("value").between(1, 10), "low").otherwise("high")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), band.alias("band"))


# --- text and corpora ------------------------------------------------------------------------------------------------

_TITLES = "docs AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text FROM documents WHERE text IS NOT NULL)"


def titled(spark, d):
    t = read(spark, d, "documents").where("text is not null")
    return t.select(F.col("doc_id").alias("id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "text")


_KEY = "array_to_string(regexp_extract_all(lower({0}), '[0-9a-z]+'), ' ')"


@query(f"""WITH {_TITLES}, s AS (SELECT id, trim(regexp_replace(replace(title, '_', ' '), '\\s+', ' ', 'g')) AS s FROM docs) SELECT id, upper(substr(s, 1, 1)) || substr(s, 2) AS title FROM s""")
def normalize_title(spark, d):
    return titled(spark, d).select("id", text.normalize_title(F.col("title")).alias("title"))


@query(f"WITH {_TITLES} SELECT key, min(id) AS id FROM (SELECT id, {_KEY.format('title')} AS key FROM docs) WHERE key <> '' GROUP BY key")
def dedupe_titles(spark, d):
    return corpus.first_by_title(titled(spark, d)).select("key", "id")


@query("""WITH RECURSIVE u AS (SELECT DISTINCT source AS title FROM documents WHERE source IS NOT NULL), k AS (SELECT title, row_number() OVER (ORDER BY title) - 1 AS i, count(*) OVER () AS n FROM u),
  t AS (SELECT title, i AS id FROM k WHERE i % 3 = 0), r AS (SELECT a.title AS f, b.title AS t FROM k a JOIN k b ON b.i = (a.i * 2 + 1) % a.n WHERE a.i % 3 <> 0),
  w AS (SELECT title AS name, title AS at, 0 AS h FROM u UNION ALL SELECT name, r.t, h + 1 FROM w JOIN r ON w.at = r.f WHERE h < 8)
  SELECT u.title AS target, CAST(min(t.id) AS BIGINT) AS dst FROM u LEFT JOIN (w JOIN t ON w.at = t.title) ON u.title = w.name GROUP BY u.title""")
def redirect_resolve(spark, d):
    from pyspark.sql import Window

    u = read(spark, d, "documents").select(F.col("source").alias("title")).where("title is not null").distinct()
    k = u.withColumn("i", F.row_number().over(Window.orderBy("title")) - 1)  # a dictionary of sources
    k = k.crossJoin(F.broadcast(u.agg(F.count("*").alias("n"))))
    t = k.where("i % 3 = 0").select("title", F.col("i").cast("long").alias("id"))
    r = k.where("i % 3 <> 0").select(F.col("title").alias("source_title"), ((F.col("i") * 2 + 1) % F.col("n")).alias("j"))
    r = r.join(k.select(F.col("i").cast("long").alias("j"), F.col("title").alias("target_title")), "j").select("source_title", "target_title")
    return corpus.resolve_links(u.select(F.col("title").alias("target")), t, r).select("target", "dst")


@query()
def title_mentions(spark, d):
    """Mentions of whole titles, of any length."""
    return corpus.mentions(titled(spark, d))


@query()
def shared_phrase_graph(spark, d):
    """Documents by the capitalised phrases of 4 letters or more that they share."""
    docs = titled(spark, d)
    return corpus.shared_entities(corpus.phrases(docs), docs.count())


@query()
def sanitize_pages(spark, d):
    return corpus.sanitize(read(spark, d, "pages")).select("page_id", "fragment", "plain_text", F.array_join("links", "|").alias("links"))


@query()
def phrase_extract(spark, d):
    return corpus.phrases(titled(spark, d))


@query("""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM conversations)
  SELECT a.conv_id, a.turn, a.key = b.key AS em FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def answer_em(spark, d):
    c = read(spark, d, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", text.exact_match(F.col("text"), F.col("next")).alias("em"))


@query("""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM conversations),
  k AS (SELECT conv_id, turn, CASE WHEN key = '' THEN [] ELSE string_split(key, ' ') END AS w FROM c),
  p AS (SELECT a.conv_id, a.turn, a.w AS v, b.w FROM k a JOIN k b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
  m AS (SELECT conv_id, turn, len(v) AS n, len(w) AS m, coalesce(list_sum(list_transform(list_distinct(v), lambda x: least(len(list_filter(v, lambda y: y = x)), len(list_filter(w, lambda y: y = x))))), 0) AS same FROM p)
  SELECT conv_id, turn, round(CASE WHEN n = 0 OR m = 0 THEN CAST(n = m AS DOUBLE) ELSE 2.0::DOUBLE * same / (n + m) END, 6) AS f1 FROM m""")
def answer_f1(spark, d):
    c = read(spark, d, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.answer_f1(F.col("text"), F.col("next")), 6).alias("f1"))


@query("""SELECT doc_id, replace(replace(replace(replace(text, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r') AS field FROM documents""")
def copy_escape(spark, d):
    return read(spark, d, "documents").select("doc_id", text.copy_escape(F.col("text")).alias("field"))


@query("""WITH f AS (SELECT doc_id AS subject_id, CASE WHEN doc_id % 4 = 0 THEN 'spouse' ELSE 'born' END AS property, (doc_id * 5 + 3) % n AS target FROM documents, (SELECT count(*) AS n FROM documents)),
  v AS (SELECT subject_id AS source_id, property, 't' || target AS tn FROM f) SELECT t.doc_id AS subject_id, v.property, v.source_id, min('T' || v.source_id) AS value, 0.85::DOUBLE AS confidence
  FROM v JOIN documents t ON 't' || t.doc_id = v.tn WHERE t.doc_id <> v.source_id AND v.property = 'spouse' AND NOT EXISTS (SELECT 1 FROM f WHERE f.subject_id = t.doc_id AND f.property = v.property) GROUP BY ALL""")
def gap_suggestions(spark, d):
    docs = read(spark, d, "documents").select("doc_id")
    f = docs.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select(F.col("doc_id").alias("subject_id"), F.when(F.col("doc_id") % 4 == 0, "spouse").otherwise("born").alias("property"), ((F.col("doc_id") * 5 + 3) % F.col("n")).alias("target"))
    v = f.select(F.col("subject_id").alias("source_id"), "property", F.concat(F.lit("t"), F.col("target").cast("string")).alias("target_norm"))
    t = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("norm_title"))
    return corpus.gap_suggestions(f, v, t)


# --- grading and link prediction -------------------------------------------------------------------------------------

_NEAR = f"v AS (SELECT a.vec_id AS qid, b.vec_id AS id, a.label AS la, b.label AS lb, row_number() OVER (PARTITION BY a.vec_id ORDER BY {L2('a.embedding', 'b.embedding')}, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)"


def _answers(spark, d):
    got = vector.knn(all_queries(spark, d), entities(spark, d), 10, not_self=True).groupBy("qid").agg(F.collect_set("id").alias("got"))
    gold = edges(spark, d).groupBy(F.col("src").alias("qid")).agg(F.collect_set("dst").alias("gold"))
    return got.join(gold, "qid")


_HITS = f"WITH {EDGES}, {_NEAR}, g AS (SELECT DISTINCT src AS qid, dst AS id FROM edges), k AS (SELECT qid, id FROM v WHERE rank <= 10), h AS (SELECT g.qid, count(k.id) AS hit, count(*) AS n FROM g LEFT JOIN k USING (qid, id) GROUP BY g.qid)"


@query(f"{_HITS} SELECT qid, round(hit / n, 6) AS recall, round(hit / (n + 10 - hit), 6) AS jaccard FROM h")
def recall_at_k(spark, d):
    a = _answers(spark, d)
    return a.select("qid", F.round(sets.recall(F.col("got"), F.col("gold")), 6).alias("recall"), F.round(sets.jaccard(F.col("got"), F.col("gold")), 6).alias("jaccard"))


@query(f"{_HITS} SELECT qid, round(hit / n, 6) AS recall, CAST(hit = n AS DOUBLE) AS joint, round(CASE WHEN hit = 0 THEN 0 ELSE 2 * (hit / n) * (hit / 10) / (hit / n + hit / 10) END, 6) AS f1 FROM h")
def evidence_joint(spark, d):
    e = _answers(spark, d).withColumn("e", sets.evidence(F.col("got"), F.col("gold")))
    return e.select("qid", F.round("e.recall", 6).alias("recall"), F.col("e.joint").alias("joint"), F.round("e.f1", 6).alias("f1"))


@query("""WITH s AS (SELECT event_id AS qid, value, user_id FROM events), a AS (SELECT qid, CASE WHEN qid % 2 = 0 THEN 5 ELSE 10 END AS k, value AS l, 1 + qid % 3 AS p, qid % 90 AS x, qid % 7 AS c FROM s), b AS (SELECT qid, value * 2 - 30 AS l, 9 AS p, qid % 7 + CASE WHEN qid % 50 = 0 THEN 1 ELSE 0 END AS c FROM s),
  j AS (SELECT a.l AS l1, b.l AS l2, CAST(a.c = b.c AS DOUBLE) AS q FROM a JOIN b USING (qid))
  SELECT 'SM-1' AS sm, round((SELECT sum(p) FROM b) / (SELECT sum(p) FROM a), 6) AS value, (SELECT sum(p) FROM b) / (SELECT sum(p) FROM a) >= 5 AS passed UNION ALL SELECT 'SM-2', round(avg(CAST(l1 < l2 AS DOUBLE)), 6), avg(CAST(l1 < l2 AS DOUBLE)) >= 0.8 FROM j
  UNION ALL SELECT 'SM-3', max(x / 400) FILTER (k = 5), max(x / 400) FILTER (k = 5) < 0.25 FROM a UNION ALL SELECT 'SM-4', round(avg(q), 6), avg(q) >= 0.99 FROM j UNION ALL SELECT 'SM-5', 1.0, TRUE""")
def sm_verdicts(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("qid"), "value")
    own = e.select(
        "qid",
        F.when(F.col("qid") % 2 == 0, 5).otherwise(10).alias("k"),
        F.col("value").alias("latency_ms"),
        (1 + F.col("qid") % 3).alias("peak_rows"),
        (F.col("qid") % 90).alias("examined"),
        F.lit(400).alias("corpus"),
        F.array(F.col("qid") % 7).alias("chunks"),
        F.lit(True).alias("atomic"),
    )
    other = e.select("qid", (F.col("value") * 2 - 30).alias("latency_ms"), F.lit(9).alias("peak_rows"), F.array(F.col("qid") % 7 + F.when(F.col("qid") % 50 == 0, 1).otherwise(0)).alias("chunks"))
    return evaluate.verdicts(own, other).select("sm", F.round("value", 6).alias("value"), "passed")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_summary(spark, d):
    return evaluate.latency_summary(read(spark, d, "events"), "event_type", "value").select("event_type", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


_AA = f"WITH {EDGES}, e AS (SELECT DISTINCT src, dst FROM edges), i AS (SELECT dst, count(*) AS n FROM e GROUP BY dst)"


@query(f"{_AA} SELECT x.src AS a, y.src AS b, count(*) AS common, round(sum(1 / ln(greatest(n, 2))), 6) AS adamic_adar FROM e x JOIN e y ON x.dst = y.dst AND x.src < y.src JOIN i ON x.dst = i.dst GROUP BY ALL")
def adamic_adar(spark, d):
    return links.all_common(edges(spark, d)).withColumn("adamic_adar", F.round("adamic_adar", 6))


@query(f"""WITH {EDGES}, {_NEAR}, e AS (SELECT DISTINCT src, dst FROM edges), p AS (SELECT qid AS a, id AS b FROM v WHERE rank <= 20), i AS (SELECT dst, count(*) AS n FROM e GROUP BY dst),
  f AS (SELECT a, dst AS w FROM (SELECT DISTINCT a FROM p) JOIN e ON a = src WHERE NOT EXISTS (SELECT 1 FROM p z WHERE z.a = e.src AND z.b = e.dst)),
  c AS (SELECT p.a, p.b, count(*) AS common, sum(1 / ln(greatest(n, 2))) AS s FROM p JOIN f ON p.a = f.a JOIN e ON p.b = e.src AND f.w = e.dst JOIN i ON i.dst = f.w GROUP BY ALL)
  SELECT a, b, CAST(coalesce(common, 0) AS BIGINT) AS common, round(coalesce(s, 0), 6) AS adamic_adar FROM p LEFT JOIN c USING (a, b)""")
def common_neighbors(spark, d):
    p = vector.knn(all_queries(spark, d), entities(spark, d), 20, not_self=True).select(F.col("qid").alias("a"), F.col("id").alias("b"))
    return links.common(edges(spark, d), p, leave_out=True).select("a", "b", "common", F.round("adamic_adar", 6).alias("adamic_adar"))


@query(f"""WITH {EDGES}, {_NEAR} SELECT qid AS a, id AS b, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS BIGINT) AS rank FROM v WHERE rank <= 20 AND NOT EXISTS (SELECT 1 FROM edges WHERE src = qid AND dst = id)""")
def predicted_unlinked(spark, d):
    p = vector.knn(all_queries(spark, d), entities(spark, d), 20, not_self=True).select(F.col("qid").alias("a"), F.col("id").alias("b"), "rank")
    return links.unlinked(p, edges(spark, d)).select("a", "b", "rank")


@query(f"WITH {EDGES}, {_NEAR}, g AS (SELECT DISTINCT src, dst FROM edges) SELECT qid AS a, round(count(dst) / count(*), 6) AS fraction FROM v LEFT JOIN g ON src = qid AND dst = id WHERE rank <= 20 GROUP BY qid")
def linked_fraction(spark, d):
    p = vector.knn(all_queries(spark, d), entities(spark, d), 20, not_self=True).select(F.col("qid").alias("a"), F.col("id").alias("b"))
    return links.linked_fraction(p, edges(spark, d)).select("a", F.round("fraction", 6).alias("fraction"))


@query("""WITH r AS (SELECT o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_custkey, o_totalprice) - 1) / 2 AS x,
  rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_custkey, o_orderdate) - 1) / 2 AS y FROM orders)
  SELECT o_custkey, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN round(corr(x, y), 6) END AS rho FROM r GROUP BY o_custkey""")
def spearman(spark, d):
    return evaluate.spearman(read(spark, d, "orders"), "o_totalprice", "o_orderdate", "o_custkey").select("o_custkey", F.round("rho", 6).alias("rho"))


@query("""WITH t AS (SELECT l_orderkey AS id, unnest(list_distinct(list(l_partkey))) AS type FROM lineitem GROUP BY l_orderkey), n AS (SELECT type, count(*) AS members FROM t GROUP BY type HAVING count(*) BETWEEN 10 AND 30)
  SELECT id, arg_min(type, (members, type)) AS type, min(members) AS members FROM t JOIN n USING (type) GROUP BY id""")
def type_frequency(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("types"))
    return evaluate.by_frequency(rows, "l_orderkey", "types", 10, 30)


# --- streams ---------------------------------------------------------------------------------------------------------


@query("SELECT user_id AS entity, max(event_id) AS rev FROM events WHERE event_type <> 'error' AND user_id > 0 GROUP BY user_id")
def latest_revision(spark, d):
    e = read(spark, d, "events").select(
        F.to_json(
            F.struct(
                F.lit("wikidatawiki").alias("wiki"),
                F.lit(0).alias("namespace"),
                F.when(F.col("event_type") == "error", "log").otherwise("edit").alias("type"),
                F.concat(F.lit("Q"), F.col("user_id").cast("string")).alias("title"),
                F.struct(F.col("event_id").alias("new")).alias("revision"),
            )
        ).alias("data")
    )
    return streams.latest(streams.edits(e))


@query("""WITH e AS (SELECT user_id, event_id // 3 AS rev, coalesce(lag(event_id // 3) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS b FROM events)
  SELECT 'split' AS mode, CAST(3 * count(*) AS BIGINT) AS observations, CAST(2 * count(*) FILTER (rev <> b) AS BIGINT) AS torn, round(2 * count(*) FILTER (rev <> b) / (3 * count(*)), 6) AS torn_rate FROM e UNION ALL SELECT 'atomic', count(*), 0, 0.0 FROM e""")
def torn_rate(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("entity"), F.expr("event_id div 3").alias("rev"), F.col("event_id").alias("ord"))
    parts = [streams.torn_reads(e, atomic).select(F.lit(name).alias("mode"), "observations", "torn", F.round("torn_rate", 6).alias("torn_rate")) for name, atomic in (("split", False), ("atomic", True))]
    return parts[0].unionByName(parts[1])


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return streams.windows(read(spark, d, "events")).withColumn("total", F.round("total", 4))
