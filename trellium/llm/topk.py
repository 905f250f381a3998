"""Exact top-k by inner product: a set of query rows against all rows of the table.

Vectors are taken in order of descending length and packed in blocks.  An SVD of the whole table
(from its Gram matrix, summed over all rows) rotates them so that leading coordinates carry most of
the length.  Blocks are worked in waves, the longest vectors first, each wave four times the one
before.  After each, a query's k-th best so far is its bound: a block of vectors meets a block of
queries only if the product of lengths can reach a bound (Cauchy-Schwarz), and within the two a
partial sum over the leading coordinates plus the product of the residual lengths discards most
vectors; what is left is multiplied in full, in double precision.  Rotated sums only discard, with
slack for rounding, so results are exact.

Result: (vec_id, rank, neighbor_id, score), rank 1 to k by score descending, then id, for each query.
A row is no neighbour of its own id.

Nulls: rows with a null id, a null vector, or a vector with a null or a value that isn't finite are
left out.  Vectors of another length than most (the smallest such length if several are as common)
are left out.  Of rows that share an id, the one with the largest vector (value by value) counts.
Zero vectors have product 0 with all.  Extra columns are ignored.  Fewer than k others give fewer
rows; an empty table, or one without queries, gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared, vectors

#: Vectors of a block, and queries that are multiplied at a time.
BLOCK, STRIP = 4096, 256
#: How many times as many blocks a wave has as the one before.
GROWTH = 4


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def rotation(df: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of the table, by descending singular value; one dims x dims matrix."""

    def add(acc: np.ndarray, b: pa.RecordBatch) -> None:
        m = _matrix(b.column(1), dims).astype(np.float64)
        acc += (m.T @ m).ravel()

    values, basis = np.linalg.eigh(vectors.total(df, dims * dims, add).reshape(dims, dims))
    return np.ascontiguousarray(basis[:, np.argsort(-values)])


def _pack(df: DataFrame, dims: int, basis: np.ndarray) -> DataFrame:
    """Blocks of rows that arrive by descending length, with the range of lengths that they come from (0 has the longest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, at, part = [], [], 0, TaskContext.get().partitionId()

        def out(i: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            m = np.ascontiguousarray(m, np.float64)
            length = float(np.sqrt((m * m).sum(axis=1)).max())
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "length": [length], "ids": [i.tobytes()], "plain": [m.tobytes()], "turned": [(m @ basis).astype(np.float32).tobytes()]})

        for b in batches:
            ids.append(b.column(0).to_numpy())
            rows.append(_matrix(b.column(1), dims))
            at += b.num_rows
            if at >= BLOCK:
                i, m = np.concatenate(ids), np.concatenate(rows)
                for s in range(0, at - at % BLOCK, BLOCK):
                    yield out(i[s : s + BLOCK], m[s : s + BLOCK])
                ids, rows, at = [i[at - at % BLOCK :]], [m[at - at % BLOCK :]], at % BLOCK
        if at:
            yield out(np.concatenate(ids), np.concatenate(rows))

    return df.mapInArrow(run, "part int, length double, ids binary, plain binary, turned binary")


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, column, score) of the k best of each query."""
    out = []
    for s in range(0, len(q), STRIP):
        p = q[s : s + STRIP] @ m.T
        p[q_ids[s : s + STRIP, None] == ids[None, :]] = -np.inf
        n = min(k, p.shape[1])
        cut = -np.partition(-p, n - 1, axis=1)[:, n - 1 : n]
        r, c = np.nonzero((p >= cut - 1e-9 * (1 + np.abs(cut))) & (p > -np.inf))
        out.append((r + s, c))
    r, c = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
    return r, c, np.einsum("ij,ij->i", q[r], m[c])


def _reach(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, at_least: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, column) pairs whose product may reach the query's bound: leading coordinates, then residual lengths."""
    rows, cols = [], []
    for s in range(0, len(a), STRIP):
        p = a[s : s + STRIP, :lead] @ b[:, :lead].T
        p += ra[s : s + STRIP, None] * rb[None, :]
        r, c = np.nonzero(p >= at_least[s : s + STRIP, None])
        rows.append(r + s)
        cols.append(c)
    return np.concatenate(rows), np.concatenate(cols)


def _residual(t: np.ndarray, lead: int) -> np.ndarray:
    return np.sqrt((t[:, lead:].astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)


def _met(q: dict, m: dict, dims: int, lead: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores) that a block of queries with its bounds takes from a block of vectors."""
    wide = lambda raw, kind=np.float64: np.frombuffer(raw, kind).reshape(-1, dims)
    q_ids, ids, x, y = np.frombuffer(q["ids"], np.int64), np.frombuffer(m["ids"], np.int64), wide(q["plain"]), wide(m["plain"])
    known = dict(zip(q["bound_q"] or (), q["bound_s"] or (), strict=True))
    bound = np.array([known.get(i, -np.inf) for i in q_ids.tolist()])
    if np.isinf(bound).any():
        r, c, s = _best(q_ids, x, ids, y, k)
        return q_ids[r], ids[c], s
    xt, yt = wide(q["turned"], np.float32), wide(m["turned"], np.float32)
    most = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)).max()
    r, c = _reach(xt, yt, _residual(xt, lead), _residual(yt, lead), (bound - 1e-5 * (most + 1e-30)).astype(np.float32), lead)
    s = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", x[r[i : i + (1 << 16)]], y[c[i : i + (1 << 16)]]) for i in range(0, len(r), 1 << 16))])
    ok = (s >= bound[r]) & (q_ids[r] != ids[c])
    return q_ids[r[ok]], ids[c[ok]], s[ok]


def search(df: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", asked: Column | None = None) -> DataFrame:
    """See the module's text.  asked: the condition on `id`, the row's id, under which a row is a query; none: every row is one."""
    spark = df.sparkSession
    v = df.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    v = v.groupBy("id").agg(F.max("v").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(~bad & (F.size("v") > 0))
    common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "vec_id bigint, rank int, neighbor_id bigint, score double")
    dims, rows = common["d"], common["count"]
    v = v.where(F.size("v") == dims)
    lead = max(1, dims // 4)
    basis = rotation(v, dims)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))

    def packed(some: DataFrame, ranges: int) -> DataFrame:
        ordered = some.withColumn("n", length).repartitionByRange(ranges, F.desc("n")).sortWithinPartitions(F.desc("n"), "id").select("id", "v")
        return shared.checkpoint(_pack(ordered, dims, basis))

    ranges = max(1, -(-rows // BLOCK))
    blocks = packed(v, ranges)
    asking = v if asked is None else v.where(asked)
    asking = packed(asking, max(1, -(-asking.count() // BLOCK))).drop("part").withColumn("no", F.xxhash64("ids")) if asked is not None else blocks.drop("part").withColumn("no", F.xxhash64("ids"))
    names = ("ids", "plain", "turned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in b.schema.names}
            for i in range(b.num_rows):
                q = {n: cols[f"q_{n}"][i] for n in (*names, "bound_q", "bound_s")}
                who, ids, s = _met(q, {n: cols[n][i] for n in names}, dims, lead, k)
                yield pa.RecordBatch.from_pydict({"no": np.full(len(who), cols["q_no"][i], np.int64), "q": who, "id": ids, "score": s})

    by = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best, first, size = None, 0, 1
    while first < ranges:
        wave = blocks.where(F.col("part").between(first, first + size - 1)).drop("part")
        if best is None:
            q = asking.withColumn("bound_q", F.lit(None).cast("array<bigint>")).withColumn("bound_s", F.lit(None).cast("array<double>")).withColumn("least", F.lit(float("-inf")))
        else:
            kth = best.where(F.col("rank") == k).groupBy("no").agg(F.collect_list(F.struct("q", "score")).alias("l"))
            kth = kth.select("no", F.col("l.q").alias("bound_q"), F.col("l.score").alias("bound_s"))
            # a block with a query that has no bound yet meets every other block
            whole = F.coalesce(F.size("bound_q"), F.lit(0)) * 8 == F.octet_length("ids")
            q = asking.join(kth, "no", "left").withColumn("least", F.when(whole, F.array_min("bound_s")).otherwise(float("-inf")))
        q = q.select(*(F.col(c).alias(f"q_{c}") for c in ("no", "length", *names, "bound_q", "bound_s", "least")))
        met = q.hint("shuffle_replicate_nl").join(wave, F.col("q_length") * F.col("length") >= F.col("q_least") - 1e-9).drop("length", "q_length", "q_least")
        found = met.mapInArrow(run, "no bigint, q bigint, id bigint, score double")
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = shared.checkpoint(found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k))
        first, size = first + size, size * GROWTH
    return best.select(F.col("q").alias("vec_id"), "rank", F.col("id").alias("neighbor_id"), "score")
