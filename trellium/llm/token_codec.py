"""Byte-level BPE on DataFrames: token ids, texts from ids, and token counts.

Nulls: a null text has null ids and a null count; null ids decode to a null text.  An empty text
has no ids and count 0.  Very long texts are handled as any other.  Repeated rows each get their
own result.  Every other column of the input stays; one of the same name as a result is replaced.
An empty table gives an empty table of the same schema.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import bpe, kernels, shared


def _append(df: DataFrame, path: str, text: str, results: list[tuple[str, T.DataType]], work) -> DataFrame:
    """df with columns that work(codec, batch) makes from column `text`; the vocabulary is read once on the driver and broadcast (it doesn't grow)."""
    ranks = df.sparkSession.sparkContext.broadcast(bpe.read_ranks(path))
    name = f"{path}:{len(ranks.value)}"
    kept = shared.besides(df.schema.fields, *(n for n, _ in results))
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in results)])
    keep = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.worker_codec(name, lambda: ranks.value)
        for batch in kernels.sliced(batches, text):
            made = work(codec, batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, *(n for n, _ in results)])
        kernels.release(bpe.HELD)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", tokens: str = "tokens", count: str = "n_tokens", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """df with the token ids of each text, in order, and their number."""

    def work(codec: bpe.Codec, batch: pa.RecordBatch) -> list[pa.Array]:
        ids = codec.encode(batch.column(text))
        return [ids, pa.compute.list_value_length(ids).cast(pa.int64())]

    return _append(df, vocabulary, text, [(tokens, T.ArrayType(T.IntegerType())), (count, T.LongType())], work)


def decode(df: DataFrame, tokens: str = "tokens", text: str = "text", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """df with the text that token ids stand for."""
    return _append(df, vocabulary, tokens, [(text, T.StringType())], lambda codec, batch: [codec.decode(batch.column(tokens)).cast(pa.string())])


def encode_checked(df: DataFrame, text: str = "text", tokens: str = "tokens", count: str = "n_tokens", lossless: str = "lossless", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """encode, with a column that says whether decoding the ids gives back the text; null for a null text."""

    def work(codec: bpe.Codec, batch: pa.RecordBatch) -> list[pa.Array]:
        col = batch.column(text)
        ids = codec.encode(col)
        same = pa.compute.equal(codec.decode(ids), col.cast(pa.large_string()))
        return [ids, pa.compute.list_value_length(ids).cast(pa.int64()), same]

    return _append(df, vocabulary, text, [(tokens, T.ArrayType(T.IntegerType())), (count, T.LongType()), (lossless, T.BooleanType())], work)


def count_tokens(df: DataFrame, text: str = "text", count: str = "n_tokens", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """df with the number of tokens of each text; no ids are made."""
    return _append(df, vocabulary, text, [(count, T.LongType())], lambda codec, batch: [codec.count(batch.column(text))])
