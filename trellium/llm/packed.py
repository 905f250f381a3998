"""Rows that carry packed arrays: many small values travel through an exchange as a few byte strings.

Columns: kind, part (the partition of the next exchange), uid, size, and three byte strings a, b, c
that hold arrays of 8-byte values of equal length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

U = np.uint64
SCHEMA = "kind int, part int, uid bigint, size int, a binary, b binary, c binary"


def batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "part", "uid", "size", "a", "b", "c"])


def by_part(kind: int, keys: np.ndarray, parts: int, arrays: list[np.ndarray]) -> list[tuple]:
    """One row for each part that has any of the keys, with its slices of the arrays as bytes."""
    part = (kernels.mix(keys.view(U)) % U(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    packed = [a[order] for a in arrays]
    empty = [b""] * (3 - len(arrays))
    return [(kind, p, 0, 0, *(x[bounds[p] : bounds[p + 1]].tobytes() for x in packed), *empty) for p in np.flatnonzero(np.diff(bounds)).tolist()]


def by_part_runs(kind: int, keys: np.ndarray, parts: int, owner: np.ndarray) -> list[tuple]:
    """by_part of keys and their owners, where owners stand in runs: keys, the owner of each run, the lengths of the runs (uint32)."""
    part = (kernels.mix(keys.view(U)) % U(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, keys, owner = part[order], keys[order], owner[order]
    bounds = np.searchsorted(part, np.arange(parts + 1))
    start = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])])) if len(keys) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(keys))).astype(np.uint32)
    who = owner[start]
    runs = np.searchsorted(start, bounds)
    some = np.flatnonzero(np.diff(bounds)).tolist()
    return [(kind, p, 0, 0, keys[bounds[p] : bounds[p + 1]].tobytes(), who[runs[p] : runs[p + 1]].tobytes(), length[runs[p] : runs[p + 1]].tobytes()) for p in some]


def columns(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(b.column(i).to_pylist() for i in range(7)), strict=True)


def cat(blobs: list[bytes], kind) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def exchange(df: DataFrame, parts: int) -> DataFrame:
    """df with each row in the partition that its `part` names."""
    return df.repartitionById(parts, F.col("part"))
