import json
import re

import pytest
from pyspark.sql import functions as F

from trellium.functions import sets, text
from trellium.operators import corpus, evaluate, packing
from trellium.sources import files


def col1(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(("f", "given", "want"), [
    (text.normalize_title, "  foo_bar   baz ", "Foo bar baz"),
    (text.normalize_title, None, None),
    (text.normalize_title, "", ""),
    (text.link_target, ":foo#part", "Foo"),
    (text.category_name, "Category:big_cats", "Big cats"),
    (text.category_name, "Foo", None),
    (text.item_id, "Q42", 42),
    (text.item_id, "Q0", None),
    (text.property_id, "P31", 31),
    (text.copy_escape, "a\\b\tc\nd\re", "a\\\\b\\tc\\nd\\re"),
    (text.year_month, "2023-11-05T01:02:03", 202311),
    (text.year_month, "soon", None),
    (text.title_key, "The Q-42, again!", "the q 42 again"),
    (text.prose_alias, "a b", True),
    (text.prose_alias, "a/b c", False),
    (text.answer_key, "The  Cat, an owl!", "cat owl"),
])
def test_scalars(spark, f, given, want):
    assert col1(spark, given, f) == want


def test_spans_and_answers(spark):
    assert tuple(col1(spark, "News of March and May 2023 on X", text.query_span)) == (202303, 202305)
    assert tuple(col1(spark, "in 2021", text.query_span)) == (202101, 202112)
    assert tuple(col1(spark, "whenever", text.query_span)) == (0, 0)
    r = spark.createDataFrame([("the cat sat", "a cat sat down"), ("", "the"), ("x", ""), (None, "x")], "a string, b string").select(text.answer_f1(F.col("a"), F.col("b")), text.exact_match(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in r] == [pytest.approx(0.8), 1.0, 0.0, None] and [x[1] for x in r] == [False, True, False, None]
    body = "Short.\nThis is the first long paragraph of all. It has two. And three sentences."
    assert col1(spark, body, text.summary) == "This is the first long paragraph of all. It has two."
    g = spark.createDataFrame([("Hello   big World", "x hello big\nworld y"), ("hello", "hello")], "s string, b string").select(text.grounded(F.col("s"), F.col("b"))).collect()
    assert [x[0] for x in g] == [True, False]


def test_grades(spark):
    r = spark.createDataFrame([([1, 2], [2, 3]), ([], []), ([1], [])], "a array<long>, b array<long>")
    got = r.select(sets.recall(F.col("a"), F.col("b")), sets.jaccard(F.col("a"), F.col("b")), sets.evidence(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == 0.5 and got[0][1] == pytest.approx(1 / 3) and tuple(got[0][2]) == (0.5, 0.0, 0.5)
    assert got[1][:2] == (1.0, 1.0) and got[2][0] == 0.0


def test_redirects(spark):
    t = spark.createDataFrame([("A", 1)], "title string, id long")
    chain = [(f"r{i}", f"r{i + 1}" if i < 8 else "A") for i in range(1, 9)] + [("x", "y"), ("y", "x"), ("far", "r1")]
    r = spark.createDataFrame(chain, "source_title string, target_title string")
    links = spark.createDataFrame([(0, n) for n in ("A", "r1", "x", "far", "none", None)], "src long, target string")
    got = {x["target"]: x["dst"] for x in corpus.resolve_links(links, t, r).collect()}
    assert got == {"A": 1, "r1": 1, "x": None, "far": None, "none": None, None: None}


def test_sanitize_and_facts(spark):
    html = '<html><head><title>t</title></head><body><nav>menu</nav><div class="navbox">no</div><p onclick="x()">Hi <b>you</b> &amp; <a href="./Big_Cat#x">cat</a><unknown>kept</unknown></p><table class="infobox"><tr><th>Spouse:</th><td><a href="./Ann_B">Ann</a></td></tr><tr><th>Only</th></tr></table></body></html>'
    r = corpus.sanitize(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("page_id").collect()
    assert "menu" not in r[0]["plain_text"] and "onclick" not in r[0]["fragment"] and r[0]["links"] == ["Big Cat", "Ann B"]
    assert r[0]["plain_text"].startswith("Hi you & catkept") and 'data-wiki-title="Big Cat"' in r[0]["fragment"] and "<unknown>" not in r[0]["fragment"]
    assert (r[1]["fragment"], r[1]["plain_text"], r[1]["links"]) == ("", "", []) == (r[2]["fragment"], r[2]["plain_text"], r[2]["links"])
    f = corpus.infobox_facts(spark.createDataFrame([(1, r[0]["fragment"])], "page_id long, fragment string"), "page_id").collect()
    assert [tuple(x) for x in f] == [(1, "spouse", "Ann", ["Ann B"])]


def test_mentions_and_linkify(spark):
    docs = spark.createDataFrame([(1, "Big Cat", "the owl"), (2, "Owl", "a big cat and a big catalogue"), (3, "OWL", "owl")], "id long, title string, text string")
    assert {tuple(x) for x in corpus.mentions(docs).collect()} == {(1, 2), (2, 1)}
    names = spark.createDataFrame([("big", 7), ("big cat", 1), ("owl", 2)], "name string, target long")
    got = {tuple(x) for x in corpus.linkify(docs, names, 3).collect()}
    assert got == {(1, 1, 2, 2), (2, 1, 3, 1), (2, 5, 6, 7), (3, 0, 1, 2)}


def test_entities(spark):
    claim = lambda q, rank="normal": {"mainsnak": {"snaktype": "value", "datavalue": {"type": "wikibase-entityid", "value": {"id": q}}}, "rank": rank}
    amount = {"mainsnak": {"snaktype": "value", "datavalue": {"type": "quantity", "value": {"amount": "+5"}}}, "rank": "normal"}
    e = {"type": "item", "id": "Q7", "labels": {"en": {"value": "seven"}}, "descriptions": {}, "claims": {"P31": [claim("Q1"), claim("Q2", "preferred")], "P9": [claim("Q3"), claim("Q3"), claim("P4")], "P2": [amount]}}
    lines = ["[", json.dumps(e) + ",", json.dumps({"type": "property", "id": "P1"}) + ",", json.dumps({"type": "item", "id": "Q8"}), "]"]
    ent = corpus.read_entities(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [tuple(x) for x in ent.select("id", "label").collect()] == [(7, "seven")]
    assert [tuple(x) for x in corpus.entity_edges(ent).orderBy("seq").collect()] == [(7, 9, 3, 1), (7, 31, 2, 2)]
    assert corpus.entity_types(ent).first()["types"] == [2]
    assert tuple(corpus.literals(ent, [2]).first()) == (7, 2, ["+5"])
    s, e2, lost = corpus.dense_slice(ent.select("id", "label"), corpus.entity_edges(ent))
    assert s.first()["vid"] == 0 and e2.count() == 0 and lost == 2


def test_search_and_sections(spark):
    a = spark.createDataFrame([(1, "Big cat"), (2, "Big catalogue"), (3, "Small cat"), (4, "The big cats")], "id long, title string")
    e = spark.createDataFrame([(9, 2)], "src long, dst long")
    assert [r["id"] for r in corpus.title_search(a, e, "big cat").orderBy("rank").collect()] == [1, 2, 4]
    assert corpus.title_search(a, e, "!").count() == 0
    h = spark.createDataFrame([(2, "History"), (3, "history "), (2, "Uses"), (1, "Uses"), (3, "Uses")], "id long, heading string")
    n = spark.createDataFrame([(1, 2), (1, 3)], "id long, nbr long")
    assert [tuple(x) for x in corpus.missing_sections(h, n).collect()] == [(1, "history", 2, 1)]


def test_files(spark, tmp_path):
    import numpy as np

    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "a.npy", m)
    (tmp_path / "a.fvecs").write_bytes(b"".join(np.int32(3).tobytes() + r.tobytes() for r in m))
    for name in ("a.npy", "a.fvecs"):
        assert [r["embedding"] for r in files.vectors(spark, str(tmp_path / name), 3).orderBy("id").collect()] == m[:3].tolist()
    (tmp_path / "c").mkdir()
    (tmp_path / "c/entities.csv").write_text('id,timestamp,chunk,embedding\n1,5,"a, b","{1,2}"\n')
    (tmp_path / "c/edges.csv").write_text("src,dst\n1,1\n")
    (tmp_path / "c/queries.jsonl").write_text('{"qid": "q", "embedding": [1, 2], "selected_time_range": [5]}\n')
    e, g, q = files.seed_corpus(spark, str(tmp_path / "c"))
    assert tuple(e.first()) == (1, 5, "a, b", [1.0, 2.0]) and g.count() == 1 and q.first()["selected_time_range"] == [5]
    (tmp_path / "w.xml").write_text("<mediawiki><page><title>A</title><ns>0</ns><revision><timestamp>2020-01-02T03:04:05Z</timestamp><text>hello</text></revision></page><page><title>B</title><ns>0</ns><redirect title='A'/><revision><text/></revision></page></mediawiki>")
    assert [(r["title"], r["redirect"], r["text"]) for r in files.wiki_pages(spark, str(tmp_path / "w.xml")).orderBy("title").collect()] == [("A", None, "hello"), ("B", "A", "")]
    df = spark.createDataFrame([(1, "a\tb\n"), (2, None)], "id long, t string")
    for tsv in (False, True):
        out = str(tmp_path / f"s{tsv}")
        files.write_shards(df, out, 1, tsv)
        assert files.verify(spark, out).count() == 0
    links = spark.sql("select 1L id, true usable, array(named_struct('type_id', 2, 'dst', 3L)) links union all select 4L, false, array()")
    files.write_compact(links, str(tmp_path / "k"))
    assert {str(r) for r in files.read_compact(spark, str(tmp_path / "k")).collect()} == {str(r) for r in links.collect()}


def test_evaluation(spark):
    c = spark.createDataFrame([("a", 0.9, 5.0), ("b", 0.95, 7.0), ("c", 0.99, 6.0), ("d", float("nan"), 1.0)], "tag string, recall double, latency double")
    assert evaluate.operating_point(c, 0.95).first()["tag"] == "c" and evaluate.operating_point(c, 1.0).count() == 0
    good = {"own_edges": 5, "other_edges": 5, "same_timer": True, "healthy_builds": 3, "builds": 3}
    assert evaluate.blockers({"recall": 0.9, "examined": 5}, {"recall": 0.91}, good) == []
    assert len(evaluate.blockers(None, None, {})) == 4
    assert evaluate.signed_rank([1, 2, 3], [1, 2, 3]) == (0.0, 1.0)
    mean, low, high = evaluate.bootstrap([0, 1] * 50)
    assert low < mean == 0.5 < high
    d = spark.createDataFrame([(0,), (5,), (2000,)], "degree long")
    assert [r["pages"] for r in packing.layout(d).collect()] == [0, 1, 2]


def _documents(spark):
    import pandas as pd

    from trellium import queries

    d = "/root/testdata/sf0.001"
    docs = [(r["id"], r["title"], r["text"]) for r in queries.titled(spark, d).collect()]
    assert len(docs) == pd.read_parquet(f"{d}/documents.parquet")["text"].notna().sum()
    return queries, d, docs


def test_shared_phrases_over_all_documents(spark):
    import itertools
    from collections import Counter, defaultdict

    queries, d, docs = _documents(spark)
    members = defaultdict(set)
    for p in corpus.phrases(spark.createDataFrame([(1, "Ann Lee met Ann Lee and Bob at Rome")], "id long, text string")).collect():
        members[p["phrase"]].add(p["id"])
    assert set(members) == {"ann lee", "rome"}
    members = defaultdict(set)
    for p in queries.QUERIES["phrase_extract"](spark, d).collect():
        members[p["phrase"]].add(p["id"])
    assert min(map(len, members)) < 14
    pairs = Counter()
    for ids in members.values():
        if 2 <= len(ids) <= max(2, int(0.4 * len(docs))):
            pairs.update(itertools.combinations(sorted(ids), 2))
    want = {(x, y, n) for (a, b), n in pairs.items() if n >= 2 for x, y in ((a, b), (b, a))}
    got = [tuple(r) for r in queries.QUERIES["shared_phrase_graph"](spark, d).collect()]
    assert len(got) == len(want) and set(got) == want and want


def test_mentions_of_whole_titles(spark):
    long = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, long, "x"), (2, f"{long} nine", "x"), (3, "c", f"so {long}, then"), (4, "d", "one two three four five six seven"), (5, "e", f"{long} nine")], "id long, title string, text string")
    assert {tuple(x) for x in corpus.mentions(docs).collect()} == {(3, 1), (5, 1), (5, 2)}


def test_title_mentions_over_all_documents(spark):
    queries, d, docs = _documents(spark)
    words = lambda t: " ".join(re.findall("[0-9a-z]+", t.lower()))
    first = {}
    for i, title, _ in sorted(docs):
        if words(title):
            first.setdefault(words(title), i)
    want = {(i, dst) for i, title, text in docs for key, dst in first.items() if key != words(title) and f" {key} " in f" {words(text)} "}
    got = [tuple(r) for r in queries.QUERIES["title_mentions"](spark, d).collect()]
    assert len(got) == len(want) and set(got) == want and want


def test_link_titles_are_decoded(spark):
    html = '<p><a href="./Caf%C3%A9_au_lait#x">a</a> <a href="/wiki/50%25">b</a></p>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert corpus.sanitize(pages).first()["links"] == ["Café au lait", "50%"]


def test_rank_correlation_of_flat_groups(spark):
    from trellium.operators import evaluate

    rows = [(1, 5.0, 1), (1, 5.0, 2), (2, 5.0, 3), (2, 5.0, 3), (3, 1.0, 1), (4, 1.0, 2), (4, 2.0, 1), (4, 3.0, 0), (5, None, 1), (5, None, 2)]
    got = {r["g"]: r["rho"] for r in evaluate.spearman(spark.createDataFrame(rows, "g int, x double, y int"), "x", "y", "g").collect()}
    assert got == {1: None, 2: None, 3: None, 4: pytest.approx(-1.0), 5: None}


def test_documents_share_more_phrases_than_sixty(spark):
    names = [f"Name{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    often = " and ".join(n for n in names[:70] for _ in range(2))
    docs = spark.createDataFrame([(1, f"{often} or {' or '.join(names[70:])}"), (2, " or ".join(names[95:])), (3, "x"), (4, "y"), (5, "z")], "id long, text string")
    p = corpus.phrases(docs)
    assert p.where("id = 1").count() == 100
    assert {tuple(r) for r in corpus.shared_entities(p, 5).collect()} == {(1, 2, 5), (2, 1, 5)}
    assert corpus.shared_entities(p.limit(0), 5).count() == 0


@pytest.mark.parametrize(("raw", "want"), [("ßa_b", "ẞa b"), ("ŉa", "ŉa"), ("ﬁx", "ﬁx"), ("éa", "Éa"), (" a ", "A")])
def test_titles_keep_one_first_letter(spark, raw, want):
    assert col1(spark, raw, text.normalize_title) == want
