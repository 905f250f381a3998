"""Exact self-join of texts by the Jaccard similarity of their word n-gram sets.

Token-combination prefixes: n-grams are ordered from rare to frequent.  If two sets are similar
enough, then prefixes of both, long enough that what one set can lack doesn't use them up, share a
signature.  A signature is one n-gram of the rare class, a pair of the frequent class, a triple of
the most frequent class; a prefix is extended by the n-grams that combinations cost.  Sets so small
that a combination might be missing are also indexed by each of their n-grams.  Candidates are then
verified on their full sets, so the join is exact.

The order within the rare class is by exact document frequency.  An n-gram of a single text can't
be shared, so it takes its place in the prefix and is never a signature: most texts, having enough
such n-grams, have no signature at all and leave the join early.

Texts that share a signature are candidates.  In a group of more than `crowd` texts no list of pairs
is made: each text is first compared with the group's smallest one, its pivot.  Distance being a
metric, all texts at least (1 + threshold) / 2 similar to one pivot are linked with each other; they
form a ball, and only pairs that aren't in one ball are listed and compared one by one.  So a group of
many near copies costs in proportion to its size and loses no link.

Hashes travel as packed arrays, in four exchanges: n-grams by hash (to count), those of two texts
or more by text (to make prefixes and sets), signatures by hash (to pair up), and each candidate's
set once for each group of its partners (to verify).  Signatures of more than `per_task` rows, and
groups of partners with many pairs, are spread over tasks by blocks.

Result, one row a document: doc_id, class_id (the smallest doc_id that it is joined to by a chain of
links; its own if it has none) and n_links, the number of other documents at or above the threshold,
exact copies among them.  Texts are identified by a 64-bit hash, confirmed by a second one, and copies
take part once; n-grams are compared by 64-bit hashes.

Nulls: rows with a null doc_id have no row; a null text is compared with nothing, and so are texts
without words (so empty ones): their documents are classes of their own.  A text of fewer than n words
has one n-gram, the whole.  Rows that repeat a doc_id and its text are one; a doc_id that has several
texts is linked by each of them, and never with itself.  Extra columns are ignored.  Pairs exactly at
the threshold are in.  Very long texts count in full.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, packed, shared, vectors


@dataclass(frozen=True)
class Plan:
    """Production parameters."""

    n: int = 3
    threshold: float = 0.5
    #: Bits of the table of hashed counts that assigns classes.
    bits: int = 20
    #: Shares of all texts from which an n-gram is in the class of pairs, and of triples.
    pairs_from: float = 0.02
    triples_from: float = 0.2
    #: n-grams that one task counts, and rows of one signature that one task pairs up; an n-gram of more texts is in the class of pairs.
    per_task: int = 1_500_000
    #: Texts of one signature from which they are compared with a pivot first.
    crowd: int = 16
    #: Pairs of one group that one task compares.
    cell: int = 100_000


U = np.uint64


def sets(col: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rounds of (first row, distinct n-gram hashes of all rows, bounds): each row's are sorted, bounds[i]:bounds[i + 1]."""
    raw, offsets = kernels.text_buffers(col)
    for lo, hi in kernels.rounds(offsets):
        out, bounds = [], [0]
        for i, j in kernels.rounds(offsets[lo : hi + 1], kernels.HASHED_BYTES):
            at = offsets[lo + i : lo + j + 1]
            grams, first = kernels.per_text_ngrams(kernels.Words(raw[at[0] : at[-1]], at - at[0]), n)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                g = np.sort(grams[a:b])
                if b - a > 1:
                    g = g[np.concatenate([[True], g[1:] != g[:-1]])]
                out.append(g)
                bounds.append(bounds[-1] + len(g))
        yield lo, np.concatenate(out), np.array(bounds)


class Seen:
    """Tells which texts a task met before, as far as it remembers: copies are all alike, so one will do."""

    def __init__(self, most: int = 200_000):
        self.most, self.held = most, set()

    def first(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of (uid, text) that are new."""
        new = []
        for i, u in enumerate(batch.column(0).to_pylist()):
            if u not in self.held:
                new.append(i)
                self.held.add(u)
        if len(self.held) > self.most:
            self.held.clear()
        return batch if len(new) == batch.num_rows else batch.take(pa.array(new, pa.int64()))


def need(size: np.ndarray, threshold: float) -> np.ndarray:
    """How many n-grams of a set a prefix must hold so that a similar set can't lack them all."""
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


RARE, DOC, FREQUENT, SIGNATURE, SET = range(5)
#: Signatures before its own, by value, that a signature's row names.
BEFORE = 2


def _emit(docs: DataFrame, classes: np.ndarray, plan: Plan, parts: int) -> DataFrame:
    """RARE rows (hash, uid in runs) by hash; DOC rows (uid, size) and FREQUENT rows (uid, hash, class) by uid."""
    known = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in map(seen.first, kernels.sliced(batches, "text")):
            uid = b.column(0).to_numpy()
            for lo, grams, bounds in sets(b.column(1), plan.n):
                size = np.diff(bounds)
                own = uid[lo : lo + len(size)]
                who = np.repeat(own, size)
                kind = known.value[(grams >> U(64 - plan.bits)).astype(np.int64)]
                rare = kind == 1
                rows = packed.by_part_runs(RARE, grams[rare], parts, who[rare])
                rows += packed.by_part(DOC, own[size > 0], parts, [own[size > 0], size[size > 0]])
                if not rare.all():
                    rows += packed.by_part(FREQUENT, who[~rare], parts, [who[~rare], grams[~rare], kind[~rare].astype(np.int64)])
                yield packed.batch(rows)
        kernels.release()

    return docs.mapInArrow(run, packed.SCHEMA)


def _count(df: DataFrame, parts: int) -> DataFrame:
    """RARE rows become (uid, hash, frequency) rows by uid, without those of a single text; the others pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, uids = [], []
        for b in batches:
            rest = []
            for r in packed.columns(b):
                if r[0] == RARE:
                    hashes.append(r[4])
                    uids.append(np.repeat(np.frombuffer(r[5], np.int64), np.frombuffer(r[6], np.uint32)).tobytes())
                else:
                    rest.append(r)
            if rest:
                yield packed.batch(rest)
        h = packed.cat(hashes, U)
        del hashes
        u = packed.cat(uids, np.int64)
        del uids
        order = np.argsort(h, kind="stable")
        h = h[order]
        u = u[order]
        del order
        new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        several = ~(new & np.append(new[1:], True))
        h, u = h[several], u[several]
        if len(h):
            order = np.lexsort((u, h))
            h, u = h[order], u[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (u[1:] != u[:-1])])
            h, u = h[once], u[once]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            df_ = np.diff(np.append(start, len(h)))
            each = np.repeat(df_.astype(np.int32), df_)
            del order, once, start, df_
            for i in range(0, len(h), 1 << 19):
                s = slice(i, i + (1 << 19))
                k = each[s] > 1
                yield packed.batch(packed.by_part(RARE, u[s][k], parts, [u[s][k], h[s][k], each[s][k]]))
        del h, u
        kernels.release()

    return df.mapInArrow(run, packed.SCHEMA)


def signatures(u: np.ndarray, sizes: np.ndarray, who: np.ndarray, grams: np.ndarray, kind: np.ndarray, first: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(set index, signature) of some sets.

    u: n-grams of each set that no other has; sizes: of the sets; who, grams, kind: the other n-grams,
    sorted by set and then by the global order; first: where each set's begin.
    """
    r = need(sizes, threshold)
    n = len(sizes)
    count = [np.bincount(who[kind == k], minlength=n) for k in (1, 2, 3)]
    at = np.arange(len(who)) - first[who]
    j2, j3 = at - count[0][who], at - (count[0] + count[1])[who]
    n1 = (u + count[0])[who]
    n2 = np.maximum(count[1] - 1, 0)[who]
    inside = np.select([kind == 1, kind == 2], [u[who] + at < r[who], n1 + np.maximum(j2 - 1, 0) < r[who]], n1 + n2 + np.maximum(j3 - 2, 0) < r[who])
    single = inside & (kind == 1)
    owner, sig = [who[single]], [kernels.mix(grams[single])]
    for k in (2, 3):
        pick = np.flatnonzero(inside & (kind == k))
        if len(pick):
            starts = np.flatnonzero(np.concatenate([[True], who[pick][1:] != who[pick][:-1]]))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pick)], strict=True):
                if b - a >= k:
                    g = np.sort(grams[pick[a:b]])
                    combos = np.array(list(combinations(range(b - a), k)))
                    h = np.full(len(combos), k, U)
                    for c in range(k):
                        h = kernels.mix(h * U(0xD6E8FEB86659FD93) + g[combos[:, c]])
                    owner.append(np.full(len(combos), who[pick[a]]))
                    sig.append(h)
    # what can miss a combination overlaps in at most 1 + 2 n-grams, so both sets are this small
    tiny = sizes[who] <= math.floor(3 / threshold)
    owner.append(who[tiny])
    sig.append(kernels.mix(grams[tiny] ^ U(0x5DEECE66D)))
    return np.concatenate(owner), np.concatenate(sig)


def _prefixes(df: DataFrame, plan: Plan, parts: int) -> DataFrame:
    """SIGNATURE rows (hash; uid, size and the BEFORE signatures before it) by hash, and one SET row (n-grams that others have too) for each text with a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, size, who, grams, order, kind = [], [], [], [], [], []
        for b in batches:
            for r in packed.columns(b):
                if r[0] == DOC:
                    doc.append(r[4])
                    size.append(r[5])
                elif r[0] == RARE:
                    who.append(r[4])
                    grams.append(r[5])
                    order.append(r[6])
                    kind.append(np.ones(len(r[4]) // 8, np.int64).tobytes())
                else:
                    who.append(r[4])
                    grams.append(r[5])
                    order.append(np.zeros(len(r[4]) // 8, np.int32).tobytes())
                    kind.append(r[6])
        ids, first = np.unique(packed.cat(doc, np.int64), return_index=True)
        if not len(ids):
            return
        sizes = packed.cat(size, np.int64)[first]
        w, g, f, k = np.searchsorted(ids, packed.cat(who, np.int64)), packed.cat(grams, U), packed.cat(order, np.int32), packed.cat(kind, np.int64)
        by = np.lexsort((g, f, k, w))
        w, g, k = w[by], g[by], k[by]
        if len(w):  # copies bring the same frequent n-gram again
            once = np.concatenate([[True], (w[1:] != w[:-1]) | (g[1:] != g[:-1])])
            w, g, k = w[once], g[once], k[once]
        start = np.searchsorted(w, np.arange(len(ids) + 1))
        owner, sig = signatures(sizes - np.diff(start), sizes, w, g, k, start[:-1], plan.threshold)
        by = np.lexsort((sig, owner))
        owner, sig = owner[by], sig[by]
        if len(sig):
            once = np.concatenate([[True], (owner[1:] != owner[:-1]) | (sig[1:] != sig[:-1])])
            owner, sig = owner[once], sig[once]
        before = [np.where(np.roll(owner, b) == owner, np.roll(sig, b), U(0)) if b < len(sig) else np.zeros(len(sig), U) for b in range(1, BEFORE + 1)]
        for b, x in enumerate(before, 1):
            x[:b] = 0
        rows = np.stack([ids[owner].view(U), sizes[owner].astype(U), *before], axis=1) if len(sig) else np.zeros((0, 2 + BEFORE), U)
        for i in range(0, len(sig), 1 << 17):
            s = slice(i, i + (1 << 17))
            yield packed.batch(packed.by_part(SIGNATURE, sig[s], parts, [sig[s], rows[s]]))
        rows = []
        for d in np.unique(owner).tolist():
            rows.append((SET, 0, int(ids[d]), int(sizes[d]), np.sort(g[start[d] : start[d + 1]]).tobytes(), b"", b""))
            if len(rows) == 500:
                yield packed.batch(rows)
                rows = []
        yield packed.batch(rows)
        del w, g, k, f, by, owner, sig, before
        kernels.release()

    return df.mapInArrow(run, packed.SCHEMA)


#: A pair (a, b), a < b, with null s; or a text a of a crowd: its pivot b, signature s, size z, and the signatures p, q before.
CANDIDATES = "a bigint, b bigint, s bigint, z int, p bigint, q bigint"


def _met(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of signatures-before name a common one: their pair comes up there, or by the same rule earlier still."""
    out = np.zeros(max(len(x), len(y)), bool)
    for c in range(BEFORE):
        for d in range(BEFORE):
            out |= (x[:, c] == y[:, d]) & (x[:, c] != 0)
    return out


def _listed(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs, the smaller id first."""
    x, y = np.minimum(a, b), np.maximum(a, b)
    o = np.lexsort((y, x))
    x, y = x[o], y[o]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, bool)
    return _rows(x[new], y[new])


def _rows(a: np.ndarray, b: np.ndarray, s: np.ndarray | None = None, z: np.ndarray | None = None, before: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(a)
    none = lambda t: pa.nulls(n, t)
    late = [none(pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.int64())] if s is None else [pa.array(s.view(np.int64)), pa.array(z.astype(np.int32)), *(pa.array(np.ascontiguousarray(before[:, c]).view(np.int64)) for c in range(BEFORE))]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *late], names=["a", "b", "s", "z", "p", "q"])


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, rows of uid, size and signatures before) of packed SIGNATURE rows."""
    return packed.cat(b.column("a").to_pylist(), U), packed.cat(b.column("b").to_pylist(), U).reshape(-1, 2 + BEFORE)


def _candidates(df: DataFrame, plan: Plan) -> DataFrame:
    """CANDIDATES from packed signatures: pairs of texts that share one and whose sizes allow the similarity; texts of crowds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_unpacked(b) for b in batches]
        if not sum(len(x) for x, _ in got):
            return
        s, rows = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
        del got
        u, z, before = rows[:, 0].view(np.int64), rows[:, 1].astype(np.int64), rows[:, 2:]
        order = np.lexsort((u, z, s))
        s, u, z, before = s[order], u[order], z[order], before[order]
        once = np.concatenate([[True], (s[1:] != s[:-1]) | (u[1:] != u[:-1])])
        s, u, z, before = s[once], u[once], z[once], before[once]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(start, len(s)))
        place = np.arange(len(s)) - np.repeat(start, size)
        whole = np.repeat(size, size)
        # in a small group, by size: each with the `step`-th after it, all groups at once
        for step in range(1, plan.crowd):
            i = np.flatnonzero((place + step < whole) & (whole <= plan.crowd))
            if not len(i):
                break
            i = i[z[i] >= plan.threshold * z[i + step] - 1e-9]
            for at in range(0, len(i), 1 << 19):
                k = i[at : at + (1 << 19)]
                k = k[~_met(before[k], before[k + step])]
                yield _listed(u[k], u[k + step])
        crowd = whole > plan.crowd
        if crowd.any():
            pivot = np.repeat(np.minimum.reduceat(u, start), size)
            for at in range(0, len(s), 1 << 19):
                k = np.flatnonzero(crowd[at : at + (1 << 19)]) + at
                yield _rows(u[k], pivot[k], s[k], z[k], before[k])
        del s, u, z, before, rows, order, once, place, whole
        kernels.release()

    return df.mapInArrow(run, CANDIDATES)


def _crowded(df: DataFrame, hot: np.ndarray) -> DataFrame:
    """CANDIDATES, all of crowds, of the signatures in hot buckets: no task holds a whole group."""
    known = df.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, rows = _unpacked(b)
            k = known.value[(s >> U(64 - HOT_BITS)).astype(np.int64)]
            yield _rows(rows[k, 0].view(np.int64), rows[k, 0].view(np.int64), s[k], rows[k, 1], rows[k, 2:])

    flat = df.mapInArrow(run, CANDIDATES).drop("b").distinct()
    pivots = flat.groupBy("s").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return flat.join(pivots, "s").select("a", "b", "s", "z", "p", "q")


def _cold(df: DataFrame, hot: np.ndarray) -> DataFrame:
    """Packed signatures without those in hot buckets."""
    known = df.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for kind, part, uid, size, sig, rows, _ in packed.columns(b):
                s, r = np.frombuffer(sig, U), np.frombuffer(rows, U).reshape(-1, 2 + BEFORE)
                k = ~known.value[(s >> U(64 - HOT_BITS)).astype(np.int64)]
                if k.any():
                    out.append((kind, part, uid, size, s[k].tobytes(), r[k].tobytes(), b""))
            yield packed.batch(out)

    return df.mapInArrow(run, packed.SCHEMA)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, in the order they come."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
            now = tuple(c[i] for c in cols)
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _across(crowd: DataFrame, balls: DataFrame, plan: Plan, parts: int) -> DataFrame:
    """Pairs of crowds whose texts aren't in one ball.  A signature of many rows is cut in blocks, and each two blocks meet in a task."""
    many = crowd.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > plan.per_task)
    many = shared.small(shared.checkpoint(many.select("s", F.ceil(F.col("n") / plan.per_task).cast("int").alias("blocks"))), 16)
    c = crowd.drop("b").join(balls, "a", "left").withColumn("ball", F.coalesce("ball", "a")).join(many, "s", "left")
    blocks = F.coalesce("blocks", F.lit(1))
    c = c.withColumn("k", F.pmod(F.xxhash64("a"), blocks).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), blocks - 1)))
    c = c.select("s", F.least("k", "x").alias("i"), F.greatest("k", "x").alias("j"), "k", "a", "z", "ball", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, held = [], [], 0
        for t in _grouped(batches, ["s", "i", "j"]):
            i, j, k, u, z, ball, p, q = (t.column(c).to_numpy() for c in ("i", "j", "k", "a", "z", "ball", "p", "q"))
            if (ball == ball[0]).all():
                continue
            order = np.lexsort((u, ball))
            k, u, z, ball, before = k[order], u[order], z[order], ball[order], np.stack([p[order], q[order]], axis=1)
            end = np.searchsorted(ball, ball, "right")
            for r in range(len(u)):
                other = np.arange(end[r], len(u))
                ok = np.minimum(z[other], z[r]) >= plan.threshold * np.maximum(z[other], z[r]) - 1e-9
                if i[0] != j[0]:
                    ok &= k[other] != k[r]
                other = other[ok]
                other = other[~_met(before[r : r + 1], before[other])] if len(other) else other
                if len(other):
                    left.append(np.full(len(other), u[r]))
                    right.append(u[other])
                    held += len(other)
                if held > 1 << 19:
                    yield _listed(np.concatenate(left), np.concatenate(right))
                    left, right, held = [], [], 0
        if held:
            yield _listed(np.concatenate(left), np.concatenate(right))
        kernels.release()

    return c.repartition(parts, "s", "i", "j").sortWithinPartitions("s", "i", "j").mapInArrow(run, CANDIDATES).select("a", "b")


def _verify(df: DataFrame, least: float) -> DataFrame:
    """Similar pairs among rows (uid, size, set) and (a, b) of the same group, which come sorted by group, sets first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _grouped(batches, ["g"]):
            uid, size, grams, a, b = (t.column(c).to_pylist() for c in ("uid", "size", "grams", "a", "b"))
            held = {u: (n, np.frombuffer(x, U)) for u, n, x in zip(uid, size, grams, strict=True) if x is not None}
            out = []
            for x, y in sorted((x, y) for x, y in zip(a, b, strict=True) if x is not None):
                (n, one), (m, two) = held[x], held[y]
                at = np.searchsorted(one, two)
                at[at == len(one)] = 0
                both = int((one[at] == two).sum())
                if both >= least * (n + m - both) - 1e-9:
                    out.append((x, y, both / (n + m - both)))
            if out:
                x, y, j = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(j, pa.float64())], names=["a", "b", "jaccard"])
        kernels.release()

    return df.mapInArrow(run, "a bigint, b bigint, jaccard double")


def _compared(pairs: DataFrame, sets_: DataFrame, least: float, plan: Plan, parts: int) -> DataFrame:
    """(a, b, jaccard) of the pairs that are at least so similar.

    Partners meet where the smallest of their partners says, so that a clique's sets move once; a
    meeting of more than plan.cell pairs is cut in cells by the hashes of both sides.
    """
    ends = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hint = ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("hint"))
    at = pairs.join(hint.withColumnRenamed("hint", "ha"), "a").join(hint.select(F.col("a").alias("b"), F.col("hint").alias("hb")), "b")
    at = shared.checkpoint(at.select(F.xxhash64(F.least("ha", "hb"), F.greatest("ha", "hb")).alias("g"), "a", "b"))
    big = at.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > plan.cell)
    big = shared.small(shared.checkpoint(big.select("g", F.ceil(F.sqrt(F.col("n") / plan.cell)).cast("int").alias("k"))), 16)
    k = F.coalesce("k", F.lit(1))
    at = at.join(big, "g", "left").select(F.xxhash64("g", F.pmod(F.xxhash64("a"), k), F.pmod(F.xxhash64("b"), k)).alias("g"), "a", "b")
    where = at.select("g", F.col("a").alias("uid")).unionAll(at.select("g", F.col("b").alias("uid"))).distinct()
    sent = where.join(sets_, "uid")
    none = lambda t: F.lit(None).cast(t)
    rows = sent.select("g", "uid", "size", "grams", none("bigint").alias("a"), none("bigint").alias("b")).unionByName(
        at.select("g", none("bigint").alias("uid"), none("int").alias("size"), none("binary").alias("grams"), "a", "b")
    )
    return _verify(rows.repartition(parts, "g").sortWithinPartitions("g"), least)


#: Bits of the table of hashed counts that finds signatures of very many rows.
HOT_BITS = 16


def similar_texts(texts: DataFrame, plan: Plan = Plan()) -> tuple[DataFrame, DataFrame]:
    """From (uid, text): (a, b, jaccard), a < b, of the similar pairs that aren't in one ball; (a, ball) of the texts in balls, a being in ball a too."""
    spark = texts.sparkSession

    def add(acc: np.ndarray, b: pa.RecordBatch) -> None:
        for _, grams, _ in sets(b.column(1), plan.n):
            acc[:-1] += np.bincount((grams >> U(64 - plan.bits)).astype(np.int64), minlength=len(acc) - 1)
        acc[-1] += b.num_rows

    def add_new(acc: np.ndarray, b: pa.RecordBatch, seen: Seen = Seen()) -> None:
        for part in kernels.sliced([b], "text"):
            add(acc, seen.first(part))

    counts = vectors.total(texts, (1 << plan.bits) + 1, add_new)
    rows, grams = counts[-1], counts[:-1].sum()
    from_ = lambda share: min(max(share * rows, 3), max(plan.per_task, 3))
    classes = 1 + (counts[:-1] >= from_(plan.pairs_from)).astype(np.uint8) + (counts[:-1] >= max(plan.triples_from * rows, 3))
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(grams / plan.per_task))
    shared.forget(spark)
    counted, counted_in = shared.kept_table(_count(packed.exchange(_emit(texts, classes, plan, parts), parts), parts), "counted")
    shared.forget(spark)  # the largest exchange ends before the next begins
    made, made_in = shared.kept_table(_prefixes(packed.exchange(counted, parts), plan, parts), "prefixes")
    shared.drop(spark, counted_in)
    shared.forget(spark)
    signs = made.where(F.col("kind") == SIGNATURE)

    def add_signs(acc: np.ndarray, b: pa.RecordBatch) -> None:
        acc += np.bincount((_unpacked(b)[0] >> U(64 - HOT_BITS)).astype(np.int64), minlength=len(acc))

    hot = vectors.total(signs.select("a", "b"), 1 << HOT_BITS, add_signs) > plan.per_task
    found = _candidates(packed.exchange(_cold(signs, hot) if hot.any() else signs, parts), plan)
    if hot.any():
        found = found.unionByName(_crowded(signs, hot))
    found, found_in = shared.kept_table(found, "candidates")
    shared.forget(spark)
    sets_ = made.where(F.col("kind") == SET).select("uid", "size", F.col("a").alias("grams"))
    pairs, crowd = found.where("s is null").select("a", "b"), found.where("s is not null")
    # a star around each pivot, then the balls; being in several, a text takes that of the smallest pivot
    stars = crowd.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = shared.checkpoint(_compared(stars, sets_, (1 + plan.threshold) / 2, plan, parts))
    pivots = near.select("a").distinct()
    balls = near.select(F.col("b").alias("a"), F.col("a").alias("ball")).unionByName(pivots.select("a", F.col("a").alias("ball"))).groupBy("a").agg(F.min("ball").alias("ball"))
    balls = shared.checkpoint(balls)
    every = pairs.unionByName(_across(crowd, balls, plan, parts)).distinct()
    one, two = balls.withColumnRenamed("ball", "one"), balls.select(F.col("a").alias("b"), F.col("ball").alias("two"))
    every = every.join(one, "a", "left").join(two, "b", "left").where("one is null or two is null or one <> two").select("a", "b")
    similar = shared.checkpoint(_compared(shared.checkpoint(every), sets_, plan.threshold, plan, parts))
    for folder in (made_in, found_in):
        shared.drop(spark, folder)
    return similar, balls


def _hashes(text: str) -> tuple:
    """The hash that names a text, and the one that confirms it."""
    return F.xxhash64(text), F.xxhash64(F.lit(20), F.col(text))


def _identified(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (id, text): (uid, text), and the distinct (uid, id); different texts have different uids."""
    first, second = _hashes("text")
    d = d.select("id", first.alias("uid"), second.alias("second"), "text")
    ids = shared.checkpoint(d.select("uid", "second", "id").distinct())
    met = ids.groupBy("uid").agg(F.min("second").alias("least"), F.max("second").alias("most")).where("least <> most").select("uid", "least")
    if not (met := shared.checkpoint(met)).isEmpty():  # texts that share a uid, but for the first of them, go by their second hash
        met = shared.small(met, 16)
        own = F.when(F.col("least").isNotNull() & (F.col("second") != F.col("least")), F.col("second")).otherwise(F.col("uid"))
        d, ids = (x.join(met, "uid", "left").withColumn("uid", own).drop("least") for x in (d, ids))
    return d.select("uid", "text"), ids.select("uid", "id")


def join(docs: DataFrame, plan: Plan = Plan(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, class_id, n_links): see the module's text."""
    own = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    texts, ids = _identified(own.where(F.col("text").rlike("[^ \\t\\n\\x0b\\f\\r]")))
    reps = shared.checkpoint(ids.groupBy("uid").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    similar, balls = similar_texts(texts, plan)
    # links of each text, counted in documents: those of similar texts, of its ball, and its copies
    weight = reps.select(F.col("uid").alias("b"), F.col("copies").alias("w"))
    both = similar.select("a", "b").unionAll(similar.select(F.col("b").alias("a"), F.col("a").alias("b")))
    apart = both.join(weight, "b").groupBy("a").agg(F.sum("w").alias("n"))
    inside = balls.join(weight.withColumnRenamed("b", "a"), "a")
    inside = inside.join(inside.groupBy("ball").agg(F.sum("w").alias("of")), "ball").select("a", (F.col("of") - F.col("w")).alias("n"))
    linked = apart.unionByName(inside).groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("n"))
    # components over the smallest doc_id of each text
    name = reps.select(F.col("uid").alias("b"), F.col("rep").alias("y"))
    edges = similar.select("a", "b").unionByName(balls.where("a <> ball").select("a", F.col("ball").alias("b")))
    edges = edges.join(name.select(F.col("b").alias("a"), F.col("y").alias("x")), "a").join(name, "b").select("x", "y")
    several = ids.join(reps, "uid").groupBy("id").agg(F.min("rep").alias("x"), F.max("rep").alias("z"), F.collect_set("rep").alias("all")).where("x <> z")
    edges = edges.unionByName(several.select("x", F.explode("all").alias("y")))
    roots = groups(edges.where("x <> y"), "x", "y")
    known = reps.join(linked, "uid", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    known = shared.checkpoint(known.select("uid", F.coalesce("root", "rep").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n")))
    every = ids.join(known, "uid").select("id", "class_id", "n").unionByName(own.where("text is null or not text rlike '[^ \\t\\n\\x0b\\f\\r]'").select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n")))
    return every.groupBy(F.col("id").alias("doc_id")).agg(F.min("class_id").alias("class_id"), F.sum("n").alias("n_links"))


def groups(pairs: DataFrame, a: str = "doc_id_a", b: str = "doc_id_b") -> DataFrame:
    """(id, root) for each id of the pairs: root is the smallest id of its connected component.

    Each round a node takes the smallest label among its neighbours and then its label's own label;
    labels and edges are written to the shared folder between rounds.
    """
    edges = shared.checkpoint(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).unionAll(pairs.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    labels = shared.checkpoint(edges.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.col("x")).alias("root")))
    while True:
        seen = edges.join(labels, edges["y"] == labels["id"]).groupBy(F.col("x").alias("id")).agg(F.min("root").alias("seen"))
        step = labels.join(seen, "id").select("id", F.least("root", "seen").alias("next"), F.col("root").alias("old"))
        up = step.select(F.col("id").alias("up"), F.col("next").alias("upper"))
        new = shared.checkpoint(step.join(up, step["next"] == up["up"]).select("id", F.least("next", "upper").alias("root"), "old"))
        labels = new.select("id", "root")
        if new.where("root != old").isEmpty():
            return labels


def keep_one(docs: DataFrame, plan: Plan = Plan(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with only the smallest doc_id of each class; rows with a null doc_id stay."""
    (gone,) = shared.fresh(docs.columns, "gone")
    lost = shared.checkpoint(join(docs, plan, text, doc_id).where("doc_id <> class_id").select(F.col("doc_id").alias(gone)))
    lost = shared.small(lost, 16)
    return docs.join(lost, docs[doc_id] == lost[gone], "left_anti")
