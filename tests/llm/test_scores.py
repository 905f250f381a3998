import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from trellium.llm import compression_score, mixing, queries, resampling, topk, url_filter

DATA = "/root/testdata/sf0.001"


def oracle(name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    return sorted(map(repr, (tuple(v for _, v in sorted(zip(names, r, strict=True))) for r in cur.fetchall())))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()) == oracle(name)


def test_url_filter(spark):
    entries = spark.createDataFrame([("Bad.com",), ("good.com/private",), ("x.org/a?b=1",), (None,), ("",), ("bad.com",)], "entry string")
    pages = [
        ("https://www.BAD.com:80/x#y", "bad.com"),
        ("http://a.b.bad.com", "bad.com"),
        ("notbad.com", None),
        ("good.com/private?q=2", "good.com/private"),
        ("good.com/private/more", None),
        ("http://x.org/a?b=1", "x.org/a?b=1"),
        ("x.org/a?b=2", None),
        (None, None),
        ("", None),
        ("bad.com/" + "z" * 100_000, "bad.com"),
    ]
    df = spark.createDataFrame([(i, u, "clash") for i, (u, _) in enumerate(pages)], "page_id long, url string, blocked string")
    got = {r["page_id"]: (r["blocked"], r["entry"]) for r in url_filter.mark(df, entries).collect()}
    assert got == {i: (e is not None, e) for i, (_, e) in enumerate(pages)}
    assert url_filter.mark(df.limit(0), entries).count() == 0
    assert url_filter.mark(df, entries.limit(0)).where("blocked").count() == 0


def test_colliding_keys_are_told_apart(tmp_path):
    words = [b"one", b"two"]
    url_filter._write(f"file://{tmp_path}", "0", {"keys": np.array([7, 7], np.uint64), "ends": np.array([0, 3, 6]), "text": np.frombuffer(b"".join(words), np.uint8)})
    d = url_filter.DigestArray(f"file://{tmp_path}", 0)
    assert d.holds(np.array([7, 7, 7, 8], np.uint64), ["one", "two", "six", "one"]).tolist() == [True, True, False, False]


def brute_dictionaries(docs, labels, plan):
    """Both dictionaries by plain counting: every word that occurs twice, by savings, while they fit."""
    import re
    from collections import Counter

    good = {}
    for r in labels.collect():
        if None not in (r["doc_id"], r["quality"], r["toxic"]):
            good[r["doc_id"]] = good.get(r["doc_id"], True) and r["quality"] == 1 and r["toxic"] == 0
    n, g = Counter(), Counter()
    for r in docs.collect():
        for w in re.split("[ \t\n\r]+", r["text"] or ""):
            if plan.shortest <= len(w.encode()) <= plan.longest:
                n[w] += 1
                g[w] += good.get(r["doc_id"], False)

    def made(counts):
        rows = sorted((c * (len(w.encode()) - plan.shortest + 2), w) for w, c in counts.items() if c and n[w] > 1)
        return b"".join(w.encode() + b" " for _, w in rows)

    return made(g) or made(n), made(n)


def test_compression_score(spark, documents, labels, odd):
    plan = compression_score.Plan(share=1.0)
    good, every = brute_dictionaries(documents, labels, plan)
    assert max(len(good), len(every)) <= plan.most

    def size(t, content):
        bits = (len(content) + plan.piece).bit_length()
        params = zstandard.ZstdCompressionParameters.from_level(plan.level, window_log=bits, hash_log=max(len(content).bit_length(), 17), chain_log=max(len(content).bit_length() - 1, 16), write_content_size=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        c = zstandard.ZstdCompressor(dict_data=d, compression_params=params)
        return sum(len(c.compress(t.encode()[i : i + plan.piece])) for i in range(0, max(len(t.encode()), 1), plan.piece))

    rows = compression_score.score(documents, labels.unionAll(labels), plan).collect()
    assert len(rows) == documents.count()
    for r in rows:
        a, b = size(r["text"], good), size(r["text"], every)
        assert (r["in_domain_bytes"], r["general_bytes"]) == (a, b) and r["score"] == pytest.approx((b - a) / b)
    o = compression_score.score(odd, labels).collect()
    assert len(o) == odd.count() and all((r["score"] is None) == (r["text"] is None) for r in o)
    assert compression_score.score(odd.limit(0), labels.limit(0)).count() == 0


def test_dictionaries_grow_with_the_words(spark, documents, labels):
    counts = compression_score.word_counts(documents, labels, compression_score.Plan()).where("n > 1").cache()
    sizes = [len(compression_score.dictionaries(counts, compression_score.Plan(share=s, least=1000))[1]) for s in (0.1, 0.2, 0.4)]
    assert 1000 < sizes[0] < sizes[1] < sizes[2]
    whole = counts.selectExpr("sum(octet_length(word) + 1)").first()[0]
    assert all(0.9 * s * whole < x <= s * whole for s, x in zip((0.1, 0.2, 0.4), sizes, strict=True))


def test_long_texts_stay_in_reach_of_the_dictionary():
    plan, rng = compression_score.Plan(), np.random.default_rng(1)
    content = bytes(rng.integers(0, 256, 50_000, np.uint8))
    c = compression_score.compressor(content, plan)
    far = bytes(rng.integers(0, 256, 5 << 20, np.uint8))
    assert compression_score.size_of(c, far + content[:20_000], plan) - compression_score.size_of(c, far, plan) < 500


def test_resampling_accuracy(spark, documents, labels):
    """Held-out: fitted on half of the labels, the model parts the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    plan = resampling.Plan()
    table = resampling.fit(docs, resampling.sampled_labels(labels.where(half), plan), plan)
    s = resampling.scored(docs, table, plan).join(labels.where(~half), "doc_id").where("log_weight is not null")
    s = [(r["log_weight"], r["quality"] == 1 and r["toxic"] == 0) for r in s.collect()]
    good, bad = [w for w, g in s if g], [w for w, g in s if not g]
    auc = np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good])
    assert auc > 0.8


def test_resampling_edges(spark, odd, labels):
    no = labels.limit(0)
    out = resampling.resample(odd, no)
    assert out.count() == odd.where("text is not null").count()
    mixed = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    kept = resampling.resample(odd, mixed)
    assert kept.where("text is null").count() == 0 and kept.where("doc_id = 1").count() in (0, 2)
    assert resampling.resample(odd.limit(0), mixed).count() == 0


def test_kth_largest(spark):
    rng = np.random.default_rng(3)
    for values in ([float(i % 777) for i in range(10_000)], [float(x) for x in rng.standard_normal(3000) ** 7], [2.5] * 40):
        df = spark.createDataFrame([(x,) for x in values], "x double")
        want = sorted(values, reverse=True)
        for k in (1, 13, len(values) // 2, len(values)):
            assert resampling.kth_largest(df, "x", min(k, len(values))) == want[min(k, len(values)) - 1]


def brute_resample(docs, labels, plan):
    """The draw in plain Python: models, left-out scores, border, noise and the k largest keys.  Gives {doc_id: (log weight, key)} and the ids kept."""
    rows = [r for r in docs.collect() if r["text"] is not None]
    seen = {}
    for r in labels.collect():
        if None not in (r["doc_id"], r["quality"], r["toxic"]):
            seen.setdefault(r["doc_id"], []).append(r["quality"] == 1 and r["toxic"] == 0)
    good = {i: all(v) for i, v in seen.items()}
    counts = [np.bincount(resampling.buckets(np.frombuffer(r["text"].encode(), np.uint8), plan.bits), minlength=1 << plan.bits).astype(float) for r in rows]
    size = lambda keep: {la: sum(len(r["text"].encode()) for r in rows if r["lang"] == la and keep(r)) for la in {r["lang"] for r in rows}}
    raw_size, target_size = size(lambda r: True), size(lambda r: good.get(r["doc_id"], False))
    share = {la: (raw_size[la] / sum(raw_size.values())) / (target_size[la] / sum(target_size.values())) for la in raw_size if target_size[la]}
    raw = sum(counts)
    own = [share.get(r["lang"], 0.0) if good.get(r["doc_id"], False) else 0.0 for r in rows]
    target = sum(c * w for c, w in zip(counts, own, strict=True))

    def score(c, t):
        return plan.sharpness * float((c * np.log((t + plan.smooth) / (raw * t.sum() / raw.sum() + plan.smooth))).sum() / max(c.sum(), 1)) if t.sum() > 0.5 else 0.0

    weights = [score(c, target) for c in counts]
    held = [(score(c, target - w * c), good[r["doc_id"]]) for r, c, w in zip(rows, counts, own, strict=True) if r["doc_id"] in good]
    g, o = sorted(x for x, y in held if y), sorted(x for x, y in held if not y)
    values = sorted({x for x, _ in held})
    gain = [plan.lost * sum(x >= v for x in g) / len(g) - sum(x >= v for x in o) / len(o) for v in [*values, float("inf")]]
    best = int(np.argmax(gain))
    border = values[best] if best == 0 else (values[best] + values[best - 1]) / 2
    noise = {r["doc_id"]: r["n"] for r in docs.select("doc_id", resampling._noise("doc_id", plan.seed).alias("n")).collect()}
    keys = [w + noise[r["doc_id"]] for r, w in zip(rows, weights, strict=True)]
    k = sum(w >= border for w in weights)
    cut = sorted(keys, reverse=True)[k - 1]
    return {r["doc_id"]: (w, x) for r, w, x in zip(rows, weights, keys, strict=True)}, sorted(r["doc_id"] for r, x in zip(rows, keys, strict=True) if x >= cut)


def test_resampling_against_brute_force(spark, documents, labels):
    plan = resampling.Plan(bits=12, sharpness=20.0)
    scores, want = brute_resample(documents, labels, plan)
    out = resampling.resample(documents, labels, plan).collect()
    assert sorted(r["doc_id"] for r in out) == want
    for r in out:
        assert (r["log_weight"], r["key"]) == pytest.approx(scores[r["doc_id"]], abs=1e-6)


def test_inclusion_follows_the_weights(spark):
    """Over many seeds, a row of log weight w is among the k largest keys as often as sampling without replacement in proportion to exp(w) takes it."""
    weights = [0.0, 1.0, 2.0, 0.5]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "doc_id long, w double")
    keys = np.array([[r[0] for r in df.select((F.col("w") + resampling._noise("doc_id", seed)).alias("k"), "doc_id").orderBy("doc_id").select("k").collect()] for seed in range(150)])
    first = np.bincount(keys.argmax(axis=1), minlength=4) / len(keys)
    assert np.abs(first - np.exp(weights) / np.exp(weights).sum()).max() < 0.12


def test_resampling_ties_repeats_and_names(spark, documents, labels):
    odd = documents.select("*", F.lit("mine").alias("key"), F.lit("own").alias("Log_Weight"))
    twice = labels.unionAll(labels)
    once = resampling.kept(odd, labels)
    assert once.columns == odd.columns and {(r["key"], r["Log_Weight"]) for r in once.collect()} == {("mine", "own")}
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(resampling.kept(odd, twice)) == ids(once)
    double = ids(resampling.kept(odd.unionAll(odd), labels))
    assert double[::2] == double[1::2]
    assert resampling.resample(odd, labels).columns == [*documents.columns, "log_weight", "key"]


def test_topk_edges(spark, monkeypatch):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((150, 6)) * rng.lognormal(0, 1, (150, 1))
    m[7] = m[8]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    extra = [(900, None), (None, rows[0][1]), (901, [1.0]), (902, [float("nan")] * 6), (903, [0.0] * 6), (5, rows[5][1])]
    got = {}
    for r in topk.search(spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>"), k=4).orderBy("rank").collect():
        got.setdefault(r["vec_id"], []).append(r["neighbor_id"])
    full = np.vstack([m, np.zeros(6)])
    ids = [*range(150), 903]
    for a, i in enumerate(ids):
        s = [(-float((full[a] * full[b]).sum()), j) for b, j in enumerate(ids) if j != i]
        assert got[i] == [j for _, j in sorted(s)[:4]]
    assert set(got) == set(ids)
    monkeypatch.setattr(topk, "BLOCK", 16)  # several waves, and bounds that tighten
    some = {}
    for r in topk.search(spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>"), k=4, asked=F.col("id") % 50 == 0).orderBy("rank").collect():
        some.setdefault(r["vec_id"], []).append(r["neighbor_id"])
    assert some == {i: got[i] for i in got if i % 50 == 0}
    assert topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), asked=F.col("id") < 0).count() == 0
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_mix_edges(spark, odd):
    out = mixing.mix(odd)
    assert set(odd.columns) <= set(out.columns) and out.count() <= 2 * odd.count()
    assert mixing.mix(odd.limit(0)).count() == 0
    plan = mixing.Plan(numerator=2, denominator=1)
    whole = mixing.chosen(odd, plan)
    assert whole.where("mix_tokens > 0").count() == 2 * odd.where("text rlike '[^ \\t\\n\\r]'").count()
    named = odd.withColumns({"domain": F.lit("own"), "epoch": F.lit("mine"), "source": F.lit("s" + "9" * 45)})
    got = mixing.rows(named, plan).collect()
    assert len(got) == 2 * (odd.count() - 2) + 2 and {(r["domain"], r["epoch"]) for r in got} == {("own", "mine")}
    assert {r["domain"] for r in mixing.mix(named, plan).collect()} == {"d3"}


def test_resampling_keeps_good_documents_without_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    hidden = labels.where("quality = 1 and toxic = 0 and pmod(xxhash64(doc_id), 8) = 3").select("doc_id").distinct()
    hidden = hidden.join(docs.where("text is not null").select("doc_id"), "doc_id", "left_semi")
    left = labels.join(hidden, "doc_id", "left_anti")
    weights = {r["doc_id"]: r["log_weight"] for r in resampling.resample(docs, left).select("doc_id", "log_weight").collect()}
    hidden = [r["doc_id"] for r in hidden.collect()]
    kept = sum(i in weights for i in hidden)
    print("kept", kept, "of", len(hidden))
    assert kept >= 0.94 * len(hidden)
    plan = resampling.Plan()  # noise decides near the border: a plain cut would part what stays from what goes
    every = resampling.scored(docs, resampling.fit(docs, resampling.sampled_labels(left, plan), plan), plan).where("log_weight is not null").select("doc_id", "log_weight").collect()
    gone = np.array([r["log_weight"] for r in every if r["doc_id"] not in weights])
    assert (gone > min(weights.values())).sum() >= 20


def test_resampling_leaves_own_label_out():
    plan = resampling.Plan(bits=8)
    a, b = b"an owl in a wood", b"another owl in the wood"
    n = lambda t: np.bincount(resampling.buckets(np.frombuffer(t, np.uint8), 8), minlength=256).astype(float)
    raw, weight = n(a) + n(b) + n(b"noise noise"), 1.5
    want = resampling.log_ratio(raw, weight * n(b), plan.smooth)[resampling.buckets(np.frombuffer(a, np.uint8), 8)].mean()
    assert resampling.left_out_ratio(a, weight, raw, weight * (n(a) + n(b)), plan) == pytest.approx(want)
    assert resampling.left_out_ratio(b"owl", weight, raw, weight * n(a), plan) == 0
