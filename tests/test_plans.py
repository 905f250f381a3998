import pytest
from pyspark.sql import functions as F

from trellium.operators import graph_store
from trellium.plans import graph_query, join_order


@pytest.mark.parametrize(("deg", "sel", "n", "k", "want"), [(2000, 0.6, 10**6, 5, "filter_first"), (500000, 0.6, 10**6, 5, "vector_first"), (4, 0.01, 2000, 1, "filter_first"), (4, 0.8, 2000, 2, "filter_first"), (0, 0.5, 10, 1, "vector_first")])
def test_cost_rule(spark, deg, sel, n, k, want):
    assert join_order.choose_by_cost(deg, sel * n, n, k) == want
    row = spark.range(1).select(join_order.cost_column(F.lit(deg), F.lit(sel * n), F.lit(n), F.lit(k))).first()
    assert row[0] == want


def test_threshold_rule():
    assert join_order.choose(100, 1000) == "filter_first"
    assert join_order.choose(101, 1000) == "vector_first"
    assert join_order.choose(5, 0) == "vector_first"
    assert join_order.choose(5, 5, 7.0) == "filter_first"
    assert join_order.choose(5, 10, -1.0) == "vector_first"
    assert join_order.intermediate(3, 5, "filter_first") == 3 and join_order.intermediate(3, 5, "vector_first") == 250
    for bad in (lambda: join_order.choose(None, 1), lambda: join_order.intermediate(1, 1, "x")):
        with pytest.raises(ValueError):
            bad()
    assert join_order.explain(2000, 600000, 10**6, 5)["by_cost"] == "filter_first"


def canonical(vec="[19,0,0,0,0,0,0,0]", k=2, ts="100", src=1):
    return f"""SELECT gt.chunk FROM GRAPH_TABLE (entity_graph
      MATCH (a IS entity WHERE a.id = {src}) -[IS related_to]-> (b IS entity) WHERE b.timestamp IN ({ts})
      COLUMNS (b.chunk, b.embedding)) gt ORDER BY gt.embedding <-> '{vec}' LIMIT {k};"""


def corpus(spark):
    zero = [F.lit(0.0).cast("float")] * 7
    e = spark.range(1, 2001).select("id", F.concat(F.lit("chunk "), F.col("id").cast("string")).alias("chunk"), F.when(F.col("id") == 40, 999).otherwise(100).alias("ts"), F.array(F.col("id").cast("float"), *zero).alias("embedding"))
    rows = [(1, 10, 1, 0), (1, 20, 1, 1), (1, 30, 1, 2), (1, 40, 1, 3), (1, 15, 2, 4)]
    return e, graph_store.from_edges(spark, spark.createDataFrame(rows, "src long, dst long, type_id int, seq long"), 2001)


def test_canonical_query(spark):
    e, g = corpus(spark)
    r = graph_query.graph_query(spark, canonical(), e, g)
    assert [x["chunk"] for x in r.rows.collect()] == ["chunk 20", "chunk 10"] and r.join_order == "filter_first"
    assert [x["id"] for x in graph_query.graph_query(spark, canonical(k=5), e, g).rows.collect()] == [20, 10, 30]
    assert [x["id"] for x in graph_query.graph_query(spark, canonical("{40,0,0,0,0,0,0,0}", 1), e, g).rows.collect()] == [30]


@pytest.mark.parametrize("bad", ["SELECT 1", canonical(k=0), canonical(k=10001), canonical("[1,2}"), canonical(ts=""), canonical() + " OR 1=1", canonical().replace("related_to", "knows")])
def test_off_template(bad):
    with pytest.raises(ValueError):
        graph_query.parse(bad)


def test_parse_is_tolerant_of_case_and_space():
    p = graph_query.parse(canonical(ts="1, 2 ,-3").lower().replace(" ", "  \n"))
    assert p.src == 1 and p.ts == (1, 2, -3) and p.k == 2 and len(p.vector) == 8
