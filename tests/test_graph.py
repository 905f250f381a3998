"""Graph store, snapshots and traversals."""

import random

import pytest
from pyspark.sql import functions as F

from trellium.operators import graph_store as gs
from trellium.operators import traverse
from trellium.storage import numbered


def frame(spark, rows, ddl="src long, dst long"):
    return spark.createDataFrame(rows, ddl)


def dsts(df):
    return [r["dst"] for r in df.orderBy("ord").collect()]


def test_types_and_directions(spark):
    g = gs.insert_vertices(gs.empty(spark), 5)
    g, ids = gs.register_types(g, ["works_at", "mentions", "related_to"])
    assert ids == {"works_at": 2, "mentions": 3, "related_to": 1}
    assert gs.register_types(g, ["mentions"])[1] == {"mentions": 3}
    for dst, t in ((1, 1), (2, 2), (3, 3), (4, 2)):
        g = gs.insert_edge(g, 0, dst, t)
    at = frame(spark, [(0,)], "src long")
    assert dsts(traverse.neighbours(g, at, 2)) == [2, 4]
    assert dsts(traverse.neighbours(g, at, 0)) == [1, 2, 3, 4]
    assert dsts(traverse.neighbours(g, at, 99)) == []
    assert dsts(traverse.neighbours(g, at)) == [1]
    assert dsts(traverse.neighbours(g, at, 0, scope=5)) == []
    with pytest.raises(ValueError):
        traverse.neighbours(g, at, direction=1)


def test_tombstones(spark):
    g = gs.insert_vertices(gs.empty(spark), 6)
    g, n = gs.insert_adjacency(g, 0, [1, 2, 3])
    assert n == 3 and gs.insert_adjacency(g, 0, [])[1] == 0
    g = gs.insert_edge(g, 1, 4)
    g = gs.tombstone_edges(g, frame(spark, [(0, 2), (5, 5)]))
    at = frame(spark, [(0,)], "src long")
    assert dsts(traverse.neighbours(g, at)) == [1, 3]
    g = gs.tombstone_vertices(g, frame(spark, [(1,)], "vid long"))
    assert dsts(traverse.neighbours(g, at)) == [1, 3]  # an edge into a deleted vertex is still followed
    assert dsts(traverse.neighbours(g, frame(spark, [(1,)], "src long"))) == []
    c = gs.counts(g).first()
    assert (c["vertex_count"], c["edge_count"], c["visible_edge_count"], c["allocated_vids"]) == (5, 4, 2, 6)
    with pytest.raises(ValueError):
        gs.insert_edge(g, 0, 1)
    with pytest.raises(ValueError):
        gs.insert_edge(g, 0, 77)
    assert gs.counts(gs.freeze(g)).first() == c


def test_external_ids(spark):
    g = gs.add_edges(gs.empty(spark), frame(spark, [(100, 7, 0), (100, 55, 1), (7, 100, 2)], "src long, dst long, pos long"))
    assert dsts(traverse.neighbours_ext(g, frame(spark, [(100,)], "src long"))) == [7, 55]
    assert sorted(r["vid"] for r in g.ids.collect()) == [0, 1, 2]
    g = gs.remove_edges(g, frame(spark, [(100, 7), (1, 2)]))
    assert dsts(traverse.neighbours_ext(g, frame(spark, [(100,)], "src long"), broadcast_map=True)) == [55]
    with pytest.raises(ValueError):
        gs.set_identity(g, True)


def test_store_versions(spark, tmp_path):
    s = gs.Store(spark, f"file://{tmp_path}/g")
    g = gs.insert_vertices(gs.empty(spark), 3)
    assert s.publish(gs.insert_edge(g, 0, 1), names=frame(spark, [(0, "a")], "id long, name string")) == 1
    old = s.load()
    assert s.publish(gs.insert_edge(old, 0, 2)) == 2
    assert old.live.count() == 1 and s.load().live.count() == 2 and s.load(1).live.count() == 1
    s.lock()
    with pytest.raises(RuntimeError):
        s.publish(g)
    assert s.load().live.count() == 2
    s.unlock()


def brute(adj, start, depth):
    seen, front = {start: 0}, [start]
    for d in range(1, depth + 1):
        front = [w for v in front for w in adj.get(v, []) if w not in seen and not seen.update({w: d})]
    return {v: d for v, d in seen.items() if v != start}


def test_bfs_and_paths_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(60), rng.randrange(60)) for _ in range(120)]
    adj, und = {}, {}
    for a, b in rows:
        adj.setdefault(a, []).append(b)
        und.setdefault(a, []).append(b)
        und.setdefault(b, []).append(a)
    e = frame(spark, rows)
    starts = frame(spark, [(v, v) for v in range(60)], "qid long, seed long")
    got = {(r["qid"], r["vid"]): r["depth"] for r in traverse.bfs(e, starts, 3).collect()}
    assert got == {(v, w): d for v in range(60) for w, d in brute(adj, v, 3).items()}
    pairs = [(a, (a * 7 + 5) % 60) for a in range(60)]
    hops = {(r["a"], r["b"]): r["hops"] for r in traverse.hop_distance(e, frame(spark, pairs, "a long, b long")).collect()}
    assert hops == {(a, b): 0 if a == b else brute(und, a, 6).get(b) for a, b in pairs}
    a, b = next((p for p in pairs if hops[p] and hops[p] > 2))
    path = traverse.connection_path(e, a, b)
    assert len(path) == hops[a, b] + 1 and all(y in und[x] for x, y in zip(path, path[1:], strict=False))
    assert traverse.connection_path(e, 5, 5) == [5]
    assert traverse.connection_path(frame(spark, [(1, 2), (3, 4)]), 1, 4) is None


def test_bounded_reach(spark):
    rows = [(0, d, 1, d) for d in range(1, 1001)] + [(v, 1000 + v, 1, 0) for v in range(1, 201)]
    g = gs.from_edges(spark, frame(spark, rows, "src long, dst long, type_id int, seq long"), 1300)
    start = frame(spark, [(0, 0)], "qid long, seed long")
    found, m = traverse.bounded(g, start, 2)
    assert found.count() == 1200 and m.first()[1:] == (1200, False)
    found, m = traverse.bounded(g, start, 2, budget=3)
    assert [r["vid"] for r in found.orderBy("ord").collect()] == [1, 2, 3] and m.first()[1:] == (3, True)
    with pytest.raises(ValueError):
        traverse.bounded(g, start, 2, budget=0)


def test_numbering_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 10007).alias("x")).repartition(7)
    got = [(r["x"], r["n"]) for r in numbered(df, ["x"], "n", 5).collect()]
    assert sorted(got) == [(x, i + 5) for i, x in enumerate(sorted(x for x, _ in got))]


def test_visibility(spark):
    log = frame(spark, [(1, "insert", 0, 1, 1, 0), (2, "insert", 0, 2, 1, 1), (3, "delete", 0, 1, 1, 0), (4, "delete", 0, 2, 1, 1)], "txn long, op string, src long, dst long, type_id int, seq long")
    seen = lambda done: [r["dst"] for r in gs.visible(log, frame(spark, [(t, t in done) for t in range(1, 5)], "txn long, committed boolean")).collect()]
    assert seen({1, 2, 3}) == [2] and seen({1}) == [1] and seen(set()) == [] and sorted(seen({1, 2})) == [1, 2]


def test_paths_beyond_the_row_limit_of_recursion(spark):
    from trellium import queries

    d = "/root/testdata/sf0.001"
    links = {}
    for r in queries.edges(spark, d).where("type_id = 1").collect():
        links.setdefault(r["src"], set()).add(r["dst"])
    want = {}
    for a, out in links.items():
        paths = [(a, v) for v in out]
        ends = set(out)
        for _ in range(2):
            paths = [(*p, v) for p in paths for v in links.get(p[-1], ()) if v not in p]
            ends |= {p[-1] for p in paths}
        want[a] = len(ends)
    spark.conf.set("spark.sql.cteRecursionRowLimit", 100)
    try:
        assert {r["a"]: r["n"] for r in queries.QUERIES["rel_recursive_paths"](spark, d).collect()} == want
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
