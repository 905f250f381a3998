import json

import pytest
from pyspark.sql import functions as F

from trellium.api import sql_functions
from trellium.api.memory import Memory
from trellium.operators import graph_store
from trellium.streaming import edits


def change(entity, rev, **over):
    return json.dumps({"wiki": "wikidatawiki", "namespace": 0, "type": "edit", "title": f"Q{entity}", "revision": {"new": rev}} | over)


def test_framing(spark, tmp_path):
    raw = ": hi\nid: 7\ndata: {\"a\":\ndata: 1}\n\nid: 8\n\ndata: tail"
    assert list(edits.frames(raw.split("\n"))) == [("7", '{"a":\n1}'), (None, "tail")]
    (tmp_path / "s.txt").write_text(raw)
    assert [(r["event_id"], r["data"]) for r in edits.read_frames(spark, str(tmp_path / "s.txt")).collect()] == [("7", '{"a":\n1}'), (None, "tail")]


def test_edits_and_latest(spark):
    rows = [change(1, 5), change(1, 9), change(1, 7), change(2, 3), change(3, 1, wiki="x"), change(4, 1, namespace=1), change(5, 1, revision={}), "junk", None]
    e = edits.edits(spark.createDataFrame([(r,) for r in rows], "data string"))
    assert {tuple(r) for r in edits.latest(e).collect()} == {(1, 9), (2, 3)}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join([change(1, 5), change(2, 3)]))
    source = lambda: edits.edits(spark.readStream.text(str(tmp_path / "in")), "value")
    assert edits.record(source(), str(tmp_path / "out"), str(tmp_path / "cp")) == 2
    (tmp_path / "in/b.txt").write_text(change(1, 4))
    edits.record(source(), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    q = edits.latest_stream(source()).writeStream.format("memory").queryName("latest_rev").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("latest_rev").collect()} == {(1, 5), (2, 3)}


def test_a_bounded_recording_loses_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for f in range(3):
        (tmp_path / f"in/{f}.txt").write_text("\n".join(change(10 * f + i, 1) for i in range(1, 6)))
    source = lambda: edits.edits(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")), "value")
    where = (str(tmp_path / "out"), str(tmp_path / "cp"))
    assert edits.record(source(), *where, most=5) == 5
    assert edits.record(source(), *where, seconds=0) == 0
    assert edits.record(source(), *where, most=100) == 10
    assert spark.read.parquet(where[0]).select("entity").distinct().count() == 15


def test_torn_reads(spark):
    e = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 2)], "entity long, rev long, ord long")
    assert tuple(edits.torn_reads(e, True).first()) == (3, 0, 0.0)
    assert tuple(edits.torn_reads(e, False).first()) == (9, 6, pytest.approx(2 / 3))
    assert tuple(edits.torn_reads(e.limit(0), False).first()) == (0, 0, 0.0)


def test_memory(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/m")
    ids = m.store_memories([("note", "a", [0.0, 1.0]), ("note", "b", [1.0, 0.0]), ("fact", "c", [0.9, 0.1])])
    assert ids == [0, 1, 2]
    m.connect(0, 2, "cites")
    rows, _ = m.recall([1.0, 0.0], 2, "vector")
    assert [r["id"] for r in rows.collect()] == [1, 2]
    rows, _ = m.recall([1.0, 0.0], 2, anchor=0)
    assert [r["text"] for r in rows.collect()] == ["c"]
    assert {r["id"] for r in m.recall([1.0, 0.0], 3)[0].collect()} == {0, 1, 2}
    assert [r["id"] for r in m.neighbours(0, "cites").collect()] == [2] and m.neighbours(0, "hates").count() == 0
    assert tuple(m.stats().first()) == (3, 1, 2)


def test_sql_surface(spark):
    g = graph_store.from_edges(spark, spark.createDataFrame([(0, 1, 1, 0), (0, 2, 1, 1), (2, 3, 2, 0)], "src long, dst long, type_id int, seq long"), 4)
    sql_functions.register(spark, g)
    assert [r[0] for r in spark.sql("SELECT dst FROM gph_neighbors WHERE src = 0 ORDER BY ord").collect()] == [1, 2]
    assert spark.sql("SELECT choose_join_order(1, 10, 0.1)").first()[0] == "filter_first"
    sql_functions.reach_table(spark, g, 0, 2)
    assert spark.table("gph_reach").where(F.col("depth") == 2).first()["vid"] == 3
