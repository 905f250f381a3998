"""Python over the rows of one query at a time, without a data frame for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a worker hands back at a time.
OUT_ROWS = 1 << 16


def each_query(rows: DataFrame, order: list[Column | str], run: Callable[[int, list[list]], list[tuple]], schema: str) -> DataFrame:
    """run(qid, columns after qid as lists) for the rows of each qid in the given order; it returns rows of the schema."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def out(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), kind, strict=True)], schema=kind)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        kept: list[pa.RecordBatch] = []

        def serve(t: pa.Table) -> None:
            q = t.column(0).to_numpy()
            starts = np.flatnonzero(np.diff(q, prepend=q[0] - 1))
            cols = [c.to_pylist() for c in t.columns[1:]]
            for a, z in zip(starts, [*starts[1:], len(q)], strict=True):
                found.extend(run(int(q[a]), [c[a:z] for c in cols]))

        for b in batches:
            if not b.num_rows:
                continue
            q = b.column(0).to_numpy()
            last = int(np.searchsorted(q, q[-1]))
            if last or (kept and kept[-1].column(0)[0].as_py() != q[0]):
                # all queries but the last of this batch are whole
                serve(pa.Table.from_batches([*kept, b.slice(0, last)]))
                kept = []
            kept.append(b.slice(last))
            if len(found) >= OUT_ROWS:
                yield out(found)
                found.clear()
        if kept:
            serve(pa.Table.from_batches(kept))
        if found:
            yield out(found)

    return rows.where("qid is not null").repartition("qid").sortWithinPartitions("qid", *order).mapInArrow(go, schema)
