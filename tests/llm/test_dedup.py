import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from trellium.llm import exact_dedup, ngram_join, queries, repeats

DATA = "/root/testdata/sf0.001"


def test_heavy_hitters(spark):
    rows = [("a",)] * 400 + [("b",)] * 300 + [(f"x{i}",) for i in range(300)]
    got = {r["key"] for r in exact_dedup.heavy_hitters(spark.createDataFrame(rows, "key string").repartition(8), "key", 4).collect()}
    assert {"a", "b"} <= got and len(got) <= 4


def winners(rows):
    best = {}
    for i, t in rows:
        if t is not None:
            best[t] = min(best.get(t, (True, 0)), (i is None, i or 0))
    return sorted(None if none else i for none, i in best.values() for _ in [0] if not none) + [None] * sum(n for n, _ in best.values())


@pytest.mark.parametrize("counters", [1, 4, 512])
def test_exact_dedup(spark, documents, odd, counters):
    for docs in (documents, odd):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = exact_dedup.dedup(docs, counters=counters)
        assert out.columns == docs.columns
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert sorted([i for i, t in got if t is not None], key=lambda x: (x is None, x)) == winners(rows)
        assert Counter(i for i, t in got if t is None) == Counter(i for i, t in rows if t is None)
    assert exact_dedup.dedup(odd.limit(0)).count() == 0


def grams(t, n=3):
    w = re.findall(r"[^ \t\n\x0b\x0c\r]+", t or "")
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.5, n=3):
    """{doc_id: (class_id, n_links)} by comparing all texts."""
    ids = {i for i, _ in rows if i is not None}
    by = defaultdict(set)
    for i, t in rows:
        if i is not None and grams(t):
            by[t].add(i)
    sets = [(v, grams(t, n)) for t, v in by.items()]
    root, links = {i: i for i in ids}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1):
            (v, g), (w, h) = sets[a], sets[b]
            if a != b and len(g & h) < threshold * len(g | h) - 1e-9:
                continue
            for i in v:
                links[i] += len(w) - (a == b)
            for i in w if a != b else ():
                links[i] += len(v)
            for i in v | w:
                x, y = find(i), find(min(v))
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def classes(df):
    rows = df.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows}


def test_ngram_join_against_brute_force(spark, documents, odd):
    for docs in (documents, odd):
        assert classes(ngram_join.join(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert classes(ngram_join.join(odd.limit(0))) == {}


def clusters(seed=4):
    """Near copies in clusters of up to 60, some chained at the threshold, copies of them, and single texts."""
    import random

    rng = random.Random(seed)
    rows, base = [], [f"w{i}" for i in range(500)]
    for size in (60, 25, 3, 2, 1, 1):
        text = [rng.choice(base) for _ in range(40)]
        for _ in range(size):
            t = list(text)
            for _ in range(rng.choice((0, 1, 1, 2, 6))):
                t[rng.randrange(len(t))] = rng.choice(base)
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize(
    "plan",
    [
        ngram_join.Plan(pairs_from=0.0, triples_from=2.0),
        ngram_join.Plan(threshold=0.8, bits=8, crowd=3),
        ngram_join.Plan(crowd=2, per_task=20, cell=5),
        ngram_join.Plan(crowd=4, cell=50),
    ],
)
def test_ngram_join_of_clusters(spark, plan):
    """Crowds, balls, hot signatures in blocks and cells: no link is lost and none is made up."""
    rows = clusters()
    assert classes(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), plan)) == brute(rows, plan.threshold)


@pytest.mark.parametrize("plan", [ngram_join.Plan(pairs_from=0.0, triples_from=2.0), ngram_join.Plan(pairs_from=0.0, triples_from=0.0), ngram_join.Plan(n=1, threshold=0.3, crowd=2)])
def test_ngram_join_in_every_class(spark, plan):
    """Random small texts over few words: all n-grams frequent, so pairs and triples carry the join."""
    import random

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 14)))) for i in range(120)]
    assert classes(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), plan)) == brute(rows, plan.threshold, plan.n)


def test_ngram_join_where_hashes_meet(spark, monkeypatch):
    """Words that meet under powers of a base have no n-gram in common, and texts of one hash are told apart by the second."""
    word = lambda n, a, b: "".join((a, b)[bin(i).count("1") % 2] for i in range(n))
    rows = [(i, f"x {word(n, a, b)} y") for i, (n, a, b) in enumerate((n, a, b) for n in (1024, 2048, 4096) for a, b in ("ab", "ba"))]
    assert all(v == (i, 0) for i, v in classes(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))).items())
    real = ngram_join._hashes
    monkeypatch.setattr(ngram_join, "_hashes", lambda t: (F.pmod(real(t)[0], F.lit(20)), real(t)[1]))
    rows = clusters(5)
    assert classes(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_ngrams_of_many_texts_take_little_memory():
    """One megabyte of texts, hashed in parts: the same sets as of each text alone, and no arrays of 8 bytes for each letter of all."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    texts = [" ".join(f"w{(i * 31 + j * j) % 4999}" for j in range(300)) for i in range(600)] + ["", "a b", " "]
    col = pa.array(texts)
    assert 900_000 < sum(map(len, texts)) < 1 << 20
    tracemalloc.start()
    ((lo, grams, bounds),) = ngram_join.sets(col, 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lo == 0 and len(bounds) == len(texts) + 1 and most < 18e6
    for i in (0, 299, 599, 600, 601, 602):
        ((_, alone, _),) = ngram_join.sets(col.slice(i, 1), 3)
        assert np.array_equal(grams[bounds[i] : bounds[i + 1]], alone)


def test_keep_one(spark, documents):
    want = brute([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert {r["doc_id"] for r in ngram_join.keep_one(documents).collect()} == {i for i, (c, _) in want.items() if c == i}


def test_shared_passages_against_brute_force(spark, odd):
    plan = repeats.Plan(min_words=12, anchor=4)
    import random

    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(400)}"
    common = [[word() for _ in range(30)] for _ in range(4)]
    rows = []
    for i in range(60):
        t = [word() for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.5:
            c = rng.choice(common)
            a = rng.randrange(0, 10)
            at = rng.randrange(0, len(t) + 1)
            t[at:at] = c[a : a + rng.randrange(8, 20)]
        rows.append((i, " ".join(t)))
    rows += [(60, rows[3][1]), (61, " ".join(common[0] * 3)), (62, None), (None, rows[5][1])]
    seen = defaultdict(set)
    split = lambda t: re.findall(r"[^ \t\n\x0b\x0c\r]+", t or "")
    for i, t in rows:
        w = split(t)
        for a in range(len(w) - 11 if i is not None else 0):
            seen[tuple(w[a : a + 12])].add(i)
    want = set()
    for i, t in rows:
        w = split(t)
        marked = set()
        for a in range(len(w) - 11 if i is not None else 0):
            if len(seen[tuple(w[a : a + 12])]) > 1:
                marked |= set(range(a, a + 12))
        start = None
        windows = [a for a in range(len(w) - 11 if i is not None else 0) if len(seen[tuple(w[a : a + 12])]) > 1]
        for a in windows:
            if start is None or a > end:
                if start is not None:
                    want.add((i, start, end))
                start = a
            end = a + 12
        if start is not None:
            want.add((i, start, end))
    got = {tuple(r) for r in repeats.shared_passages(spark.createDataFrame(rows, "doc_id long, text string"), plan).collect()}
    covered = lambda spans: {(i, p) for i, a, b in spans for p in range(a, b)}
    assert covered(got) == covered(want)
    assert {r["doc_id"] for r in repeats.shared_passages(odd).collect()} == {6, 7}
    assert repeats.shared_passages(odd.limit(0)).count() == 0


def test_registered(spark, documents):
    assert queries.op7_exact_dedup(spark, DATA).where(F.col("doc_id").isNull()).count() == 0
    out = queries.op10_ngram_join(spark, DATA)
    assert out.columns == ["doc_id", "class_id", "n_links"] and out.count() == documents.select("doc_id").distinct().count()
