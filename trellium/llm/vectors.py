"""Sums of long count vectors over a whole table: each task adds up its rows, then shards of the vectors meet."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels

#: Entries of one shard of a vector.
SHARD = 1 << 12


def _rows(total: np.ndarray) -> pa.RecordBatch:
    parts = np.pad(total, (0, -len(total) % SHARD)).reshape(-1, SHARD)
    some = np.flatnonzero(parts.any(axis=1))
    return pa.RecordBatch.from_pydict({"shard": pa.array(some, pa.int32()), "blob": pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary())})


def total(df: DataFrame, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The float64 vector that `add` makes of all batches of df; each adds to the array it is given.

    What comes to the driver is one vector, whatever the table's size; tasks stream, so memory is constant too.
    """
    shards = -(-size // SHARD)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(size)
        for b in batches:
            add(acc, b)
        yield _rows(acc)
        kernels.release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            for s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(blob))
                acc[s] = acc[s] + part if s in acc else part
        yield pa.RecordBatch.from_pydict({"shard": pa.array(list(acc), pa.int32()), "blob": pa.array([a.tobytes() for a in acc.values()], pa.binary())})

    kind = "shard int, blob binary"
    out = np.zeros(shards * SHARD)
    for r in df.mapInArrow(gather, kind).repartition(min(shards, 64), "shard").mapInArrow(merge, kind).collect():
        out[r["shard"] * SHARD : (r["shard"] + 1) * SHARD] += np.frombuffer(r["blob"])
    return out[:size]
