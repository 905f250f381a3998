"""Worked examples of the fused searches."""

import pytest
from pyspark.sql import functions as F

from trellium.operators import fused, graph_store
from trellium.operators.push import push, push_by_residue
from trellium.settings import Request, Settings

MEMBERSHIP = Settings(graph_scoring="membership")


def line(spark, n, scale):
    zero = [F.lit(0.0).cast("float")] * 7
    return spark.range(n).select("id", F.when(F.col("id") < 500, 100).otherwise(900).alias("ts"), F.array((F.col("id") / scale).cast("float"), *zero).alias("embedding"))


def make(spark, rows, n):
    e = spark.createDataFrame([(s, d, t, i) for i, (s, d, t) in enumerate(rows)], "src long, dst long, type_id int, seq long")
    return graph_store.from_edges(spark, e, n)


def ask(spark, x, dim=8, **more):
    row = (0, [float(x)] + [0.0] * (dim - 1), *more.values())
    return spark.createDataFrame([row], "qid long, qvec array<double>" + "".join(f", {k} long" for k in more))


def ids(a):
    return [r["id"] for r in a.rows.orderBy("rank").collect()]


@pytest.fixture(scope="module")
def ent(spark):
    return line(spark, 2000, 2000.0)


P1 = [(2, d, 1) for d in range(1000, 1101)]
P2 = [(900, d, 2) for d in range(901, 941)]


def test_anchored(spark, ent):
    g = make(spark, P1 + P2, 2000)
    a = fused.tjs_open(ent, g, ask(spark, 0.5, src=2), Request(k=5, edge_type=1))
    assert ids(a) == [1000, 1001, 1002, 1003, 1004]
    m = a.metrics.first()
    assert (m["examined"], m["termination_reason"], m["budget_capped"]) == (101, "filter_first", False)
    b = fused.tjs_open(ent, g, ask(spark, 0.5, src=2), Request(k=5, edge_type=1, where="ts < 500"))
    assert ids(b) == [] and b.metrics.first()["examined"] == 0


def test_vector_first_stops_after_drops(spark, ent):
    a = fused.tjs_open(ent, make(spark, P1, 2000), ask(spark, 0.1), Request(k=5, term_cond=64, m_seeds=0, where="ts < 500"))
    assert ids(a) == [200, 199, 201, 198, 202]
    m = a.metrics.first()
    assert 0 < m["examined"] < 2000 and m["termination_reason"] == "term_cond"


def test_scan_budget(spark, ent):
    g = make(spark, P1, 2000)
    a = fused.tjs_open(ent, g, ask(spark, 0.1), Request(k=10, m_seeds=0), Settings(vector_scan_budget=50))
    m = a.metrics.first()
    assert len(ids(a)) == 10 and (m["examined"], m["termination_reason"], m["budget_capped"]) == (50, "scan_budget", True)
    m = fused.tjs_open(ent, g, ask(spark, 0.1), Request(k=10, m_seeds=0)).metrics.first()
    assert (m["termination_reason"], m["budget_capped"]) == ("stream_end_unknown", None)
    m = fused.tjs_open(ent, g, ask(spark, 0.1), Request(k=10, term_cond=64, m_seeds=0), Settings(vector_scan_budget=100000)).metrics.first()
    assert (m["termination_reason"], m["budget_capped"]) == ("term_cond", False)


def test_membership(spark, ent):
    a = fused.tjs_open(ent, make(spark, P1, 2000), ask(spark, 0.0011), Request(k=5, term_cond=32, m_seeds=1, edge_type=1), MEMBERSHIP)
    assert ids(a) == [2, 3, 1, 4, 1000] and a.metrics.first()["bridges"] == 102


@pytest.mark.parametrize(("k", "want"), [(5, [900, 899, 901, 898, 902]), (3, [900, 899, 901]), (2, [900, 899]), (1, [900])])
def test_membership_share_of_bridges(spark, ent, k, want):
    a = fused.tjs_open(ent, make(spark, P1 + P2, 2000), ask(spark, 0.44990), Request(k=k, term_cond=32, m_seeds=1, edge_type=2), MEMBERSHIP)
    assert ids(a) == want


def test_counts_of_work(spark, ent):
    r = Request(k=5, term_cond=8, m_seeds=1, edge_type=2)
    a = fused.tjs_open(ent, make(spark, P1 + P2, 2000), ask(spark, 0.05005), r, MEMBERSHIP)
    assert ids(a) == [100, 101, 99, 102, 98] and a.metrics.first()["examined"] == 41
    hub = [(500, d, 2) for d in range(400, 601) if d != 500]
    a = fused.tjs_open(ent, make(spark, P1 + P2 + hub, 2000), ask(spark, 0.24990), r, MEMBERSHIP)
    assert ids(a) == [500, 499, 501, 498, 502]
    assert (a.metrics.first()["examined"], a.metrics.first()["termination_reason"]) == (201, "term_cond")


PPR_EDGES = [(0, 2, 1), (0, 1, 1), (0, 3, 1), (3, 2, 1)]


def test_pagerank_order(spark):
    e = spark.createDataFrame([(0, [0.01]), (1, [0.5]), (2, [0.5]), (3, [0.5])], "id long, embedding array<float>")
    g = make(spark, PPR_EDGES, 4)
    r = Request(k=4, term_cond=1000, m_seeds=1)
    a = fused.tjs_open(e, g, ask(spark, 0, 1), r)
    assert ids(a) == [0, 2, 1, 3]
    m = a.metrics.first()
    assert (m["graph_examined"], m["graph_censored"]) == (4, False)
    assert ids(fused.tjs_open(e, g, ask(spark, 0, 1), r, MEMBERSHIP)) == [0, 1, 2, 3]


def test_push_by_hand():
    out = {0: [2, 1, 3], 3: [2]}
    got, steps, censored = push([(0, 1.0)], out, 2, 0.15, 1e-3, 65536)
    assert steps == 4 and not censored
    assert got == pytest.approx({0: 0.15, 2: 0.078625, 1: 0.0425, 3: 0.0425})
    _, steps, censored = push([(0, 1.0)], out, 2, 0.15, 1e-3, 4)
    assert steps == 4 and censored
    exact = push_by_residue([(0, 1.0)], out, 0.15, 1e-12)
    assert exact[2] == pytest.approx(0.078625)


def test_work_bound(spark):
    e = spark.range(4500).select("id", F.array((F.col("id") / 4500).cast("float")).alias("embedding"))
    rows = [(0, d, 1) for d in range(1, 1001)] + [(g, 1000 + g, 1) for g in range(1, 201)] + [(2000, d, 1) for d in range(2001, 4401)]
    g = make(spark, rows, 4500)
    a = fused.tjs_open(e, g, ask(spark, 0, 1, src=0), Request(k=1, edge_type=1))
    m = a.metrics.first()
    assert ids(a) == [1] and (m["graph_examined"], m["graph_censored"]) == (1200, False)
    a = fused.tjs_open(e, g, ask(spark, 0, 1, src=0), Request(k=5, edge_type=1), Settings(graph_work_budget=128))
    m = a.metrics.first()
    assert ids(a) == [1, 2, 3, 4, 5] and (m["graph_examined"], m["graph_censored"]) == (128, True)
    steps = []
    for src, want in ((0, 1), (2000, 2001)):
        a = fused.tjs_open(e, g, ask(spark, src / 4500, 1, src=src), Request(k=1, term_cond=8, edge_type=1))
        assert ids(a) == [want]
        steps.append(a.metrics.first()["graph_examined"])
    assert steps[0] == steps[1]
    m = fused.tjs_open(e, g, ask(spark, 0, 1), Request(k=5, term_cond=32, m_seeds=1), Settings(graph_scoring="membership", graph_work_budget=300)).metrics.first()
    assert (m["graph_examined"], m["graph_censored"]) == (300, True)


def test_filters(spark):
    e = spark.range(100).select(
        "id",
        F.when(F.col("id") < 50, 100).otherwise(900).alias("ts"),
        F.when(F.col("id") % 3 != 0, F.col("id")).cast("int").alias("nv"),
        F.concat(F.lit("e"), F.col("id").cast("string")).alias("name"),
        F.array((F.col("id") % 10).cast("int"), (F.col("id") % 7).cast("int")).alias("tags"),
        F.array((F.col("id") / 100).cast("float")).alias("embedding"),
    )
    g = make(spark, [(0, 1, 1)], 100)
    spark.udf.register("is_even", lambda x: x % 2 == 0, "boolean")
    rules = {
        "ts < 500": lambda i: i < 50,
        "tags @> ARRAY[3]": lambda i: 3 in (i % 10, i % 7),
        "tags && ARRAY[3, 4]": lambda i: {3, 4} & {i % 10, i % 7},
        "nv IS NULL": lambda i: i % 3 == 0,
        "nv > 40": lambda i: i % 3 and i > 40,
        "ts < 500.5": lambda i: i < 50,
        "length(name) > 2": lambda i: i > 9,
        "is_even(id)": lambda i: i % 2 == 0,
        "ts IN (SELECT 100)": lambda i: i < 50,
        "id = (SELECT max(x) FROM VALUES (7), (9) AS t(x))": lambda i: i == 9,
    }
    for rule, ok in rules.items():
        a = fused.tjs_open(e, g, ask(spark, 0, 1), Request(k=100, m_seeds=0, where=rule))
        assert ids(a) == [i for i in range(100) if ok(i)], rule


def test_nulls_and_empty_tables(spark):
    e = spark.createDataFrame([(0, [0.0]), (1, None), (None, [1.0]), (2, [2.0])], "id long, embedding array<float>")
    g = make(spark, [(0, 1, 1), (0, 2, 1), (0, 2, 1)], 3)
    a = fused.tjs_open(e, g, ask(spark, 0, 1, src=0), Request(k=5))
    assert ids(a) == [2] and a.metrics.first()["examined"] == 1
    for scoring in ("ppr", "membership"):
        a = fused.tjs_open(e.limit(0), g, ask(spark, 0, 1), Request(k=5, m_seeds=2), Settings(graph_scoring=scoring))
        assert ids(a) == [] and a.metrics.count() == 1
        assert set(ids(fused.tjs_open(e, g, ask(spark, 0, 1), Request(k=5, m_seeds=2), Settings(graph_scoring=scoring)))) == {0, 2}


@pytest.mark.parametrize("bad", [{"k": 0}, {"k": 10001}, {"k": 1, "hops": 9}, {"k": 1, "m_seeds": -1}, {"k": 1, "m_seeds": 10001}, {"k": 1, "where": None}, {"k": 1, "metric": "x"}])
def test_arguments(bad):
    with pytest.raises(ValueError):
        Request(**bad)
    Request(k=1, m_seeds=10000)
    with pytest.raises(ValueError):
        Settings(graph_work_budget=1)


def test_source_ranking_asks_for_few_sources(spark, monkeypatch):
    import random

    from trellium.operators import fusion, vector

    rng, asked = random.Random(4), []
    knn = vector.knn
    monkeypatch.setattr(vector, "knn", lambda q, e, k, *a, **b: asked.append(k) or knn(q, e, k, *a, **b))
    at = {i: rng.uniform(-9, 9) for i in range(60)}
    ts = {i: i % 7 for i in at}
    e = spark.createDataFrame([(i, ts[i], [x]) for i, x in at.items()], "id long, ts int, embedding array<double>")
    links = [(i, (i * 7 + j * 13) % 60, j) for i in at for j in range(1, 4)]
    q = e.select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    got = {}
    for r in fusion.source_ranked(e, spark.createDataFrame(links, "src long, dst long, seq long"), q, F.col("ts") < 5, 4).orderBy("rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    want = {}
    for i in at:
        near = sorted(at, key=lambda s: (abs(at[s] - at[i]), s))
        found = [d for s in near for _, d, _ in sorted((x for x in links if x[0] == s), key=lambda x: x[2]) if ts[d] < 5]
        want[i] = list(dict.fromkeys(found))[:4]
    assert got == want
    assert max(asked) <= 3 * 3 + 1
