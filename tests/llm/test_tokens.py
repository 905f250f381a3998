import base64

import pytest
from pyspark.sql import functions as F

from trellium.llm import bpe, queries, token_codec

tiktoken = pytest.importorskip("tiktoken")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def exact():
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_ids_and_counts_match_the_public_encoder(spark, documents, odd, exact):
    for docs in (documents, odd):
        rows = token_codec.encode_checked(docs).select("text", "tokens", "n_tokens", "lossless").collect()
        counts = {r["text"]: r["n_tokens"] for r in token_codec.count_tokens(docs).select("text", "n_tokens").collect()}
        assert len(rows) == docs.count()
        for r in rows:
            want = None if r["text"] is None else exact(r["text"])
            assert r["tokens"] == want and r["n_tokens"] == (None if want is None else len(want)) == counts[r["text"]]
            assert r["lossless"] == (None if want is None else True)


@pytest.mark.parametrize("text", ["", " ", "   a  b", "don't WE'LL", "x" * 5000, "\n\n \r\n", "a b c", "123456789,000", "ééé🙂🙂", "﻿z", "<|endoftext|>"])
def test_hard_texts(spark, exact, text):
    r = token_codec.encode_checked(spark.createDataFrame([(text,)], "text string")).first()
    assert r["tokens"] == exact(text) and r["lossless"]


def test_round_trip_and_columns(spark, odd):
    back = token_codec.decode(token_codec.encode(odd).drop("text"))
    same = lambda df: sorted(map(str, df.select("doc_id", "text").collect()))
    assert same(back) == same(odd)
    empty = token_codec.encode(odd.limit(0))
    assert empty.count() == 0 and dict(empty.dtypes)["tokens"] == "array<int>" and empty.columns.count("tokens") == 1


def test_queries_cover_the_table(spark, documents):
    for q in (queries.op1_bpe_codec, queries.op8_token_counts):
        assert q(spark, DATA).count() == documents.count()
    assert queries.op1_bpe_codec(spark, DATA).where(~F.col("lossless")).count() == 0


def thue_morse(n, first="a", second="b"):
    return "".join((first, second)[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_meet_under_powers_of_a_base(spark, exact, n):
    """Complementary Thue-Morse words have one polynomial hash modulo 2^64; here they must keep apart."""
    rows = [(0, thue_morse(n)), (1, thue_morse(n, "b", "a")), (2, f"{thue_morse(n)} {thue_morse(n, 'b', 'a')}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in token_codec.encode_checked(df).collect()}
    counts = {r["doc_id"]: r["n_tokens"] for r in token_codec.count_tokens(df).collect()}
    for i, t in rows:
        assert got[i]["tokens"] == exact(t) and got[i]["lossless"] and counts[i] == len(exact(t))


@pytest.mark.parametrize("seen", [(0, 0), (0, 1), (1, 0)])
def test_pretokens_of_one_key(exact, monkeypatch, seen):
    """With hashes that always, or in part, meet, results stay those of the public encoder."""
    import numpy as np
    import pyarrow as pa

    from trellium.llm import kernels

    real = kernels.letter_hashes
    monkeypatch.setattr(kernels, "letter_hashes", lambda a, p, which=0: real(a, p, which) if seen[which] else np.zeros(len(a), np.uint64))
    codec = bpe.Codec(bpe.read_ranks())
    texts = ["one two six ten", "dog cat owl", "abc one dog"]
    assert codec.encode(pa.array(texts)).to_pylist() == [exact(t) for t in texts]
    if any(seen):
        assert codec.count(pa.array(texts)).to_pylist() == [len(exact(t)) for t in texts]


def test_a_worker_forgets_its_codec():
    """What encoding holds stays from one of its tasks to the next, and goes when a task of another operator ends."""
    from trellium.llm import kernels

    codec = bpe.worker_codec("own", bpe.read_ranks)
    kernels.release()
    assert bpe.worker_codec("own", bpe.read_ranks) is not codec
    codec = bpe.worker_codec("own", bpe.read_ranks)
    kernels.release(bpe.HELD)
    assert bpe.worker_codec("own", bpe.read_ranks) is codec
