import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, and columns named like results."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "alpha beta gamma delta", "en", "src1"),
        (1, "alpha beta gamma delta", "en", "src1"),
        (2, "alpha beta gamma delta", None, None),
        (None, "alpha beta gamma delta", "en", "src2"),
        (3, None, "en", "src1"),
        (None, None, None, None),
        (4, "", "de", "src3"),
        (5, " \n\t", "de", "src3"),
        (6, long, "fr", "src4"),
        (7, long, "fr", "src4"),
        (8, "émigré ñandú 日本語 \u0000 🙂", "es", "x"),
    ]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, key string, tokens string, n_tokens string, digest string, score string, blocked string"
    return spark.createDataFrame([(*r, 0, "k", "t", "n", "d", "s", "b") for r in rows], ddl)
