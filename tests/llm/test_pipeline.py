"""Every stage against its own definition, on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from trellium.llm import exact_dedup, mixing, ngram_join, resampling, token_codec

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


def test_stages(spark, documents, labels):
    docs = documents
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DATA)
        if name == "quality":
            assert rows(out.select("doc_id")) == rows(resampling.resample(docs, labels).select("doc_id"))
        elif name == "exact_copies":
            texts = {r["text"]: r["doc_id"] for r in docs.orderBy("doc_id", ascending=False).collect()}
            assert {r["doc_id"] for r in out.collect()} == set(texts.values())
        elif name == "near_copies":
            assert ngram_join.join(out).where("n_links > 0").count() == 0 and out.count() < docs.count()
        elif name == "mix":
            assert rows(out.select("doc_id")) == rows(mixing.chosen(docs).select("doc_id"))
        if name == "encode":
            assert rows(token_codec.decode(out.drop("text")).select("doc_id", "text")) == rows(docs.select("doc_id", "text"))
        else:
            assert out.columns == documents.columns
        docs = out.cache()
    assert rows(cp.run(spark, DATA)) == rows(docs)


def test_columns_come_out_as_they_went_in(spark, documents):
    names = ("key", "log_weight", "domain", "epoch", "digest", "winner", "hot", "root", "lost", "whole", "stop", "uid")
    docs = documents.select("*", *(F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in names))
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, DATA)
        got = docs.select("doc_id", *names).collect()
        assert got and all(r[n] == f"{n}-{r['doc_id']}" for r in got for n in names), name


def test_odd_rows_pass_every_stage(spark, odd, tmp_path):
    docs = odd
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.where("text is null").count() == 0
    docs = odd.limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_exact_stage_uses_the_operator(spark, documents):
    assert rows(cp.exact_copies(spark, documents, DATA)) == rows(exact_dedup.dedup(documents))
