"""Passages that several documents share word for word, by a run-length index.

Every window of `min_words` words belongs to the smallest hash among its runs of `anchor` words,
so equal windows belong to the same hash, wherever they stand.  A first exchange finds the hashes
that two documents or more have; a text then sends only its windows of those, neighbours with the
same hash as one slice, to the task of the hash.  No pair of documents is ever formed.

There the distinct slices are indexed by a Burrows-Wheeler transform kept as runs, with the suffix
positions at both ends of each run as samples; the suffix order itself is let go.  Between two samples
common prefixes fall by one for each word and the neighbour in suffix order moves on by one (they are
reducible), so the matching statistics of a repetitive collection stream out over the text from as
many comparisons as there are runs.  Suffixes that share `min_words` words form a class, found by
following neighbours, and the windows of a class with two documents are marked.

Result: (doc_id, start_word, end_word), words counted from 0 over white space, end excluded; the
marked windows of a document as maximal spans.  All occurrences are marked, the first one too.

Nulls: rows with a null text or doc_id are left out.  Texts of fewer than `min_words` words, so
empty ones, have no window.  Rows that repeat a doc_id are one document: what only they share is
not shared.  A text that repeats itself is not marked for that.  Very long texts count in full.
Words are compared by 32 bits of hash each, a window so by 32 times `min_words`.  Extra columns are
ignored.  An empty table gives no spans.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, packed, shared


@dataclass(frozen=True)
class Plan:
    """Production parameters."""

    min_words: int = 50
    #: Words of the runs among which a window's smallest hash is sought.
    anchor: int = 8
    #: Words that one index holds, more only if a single hash has more.
    index_words: int = 400_000


U = np.uint64


def slices(words: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, end window) of the runs of windows of one text that belong to the same hash."""
    low = kernels.sliding_min(kernels.ngrams(words, plan.anchor), plan.min_words - plan.anchor + 1)
    if not len(low):
        return low, np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return low[start], start, np.append(start[1:], len(low))


def _texts(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of each text."""
    raw, offsets = kernels.text_buffers(col)
    for lo, hi in kernels.rounds(offsets):
        w = kernels.Words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for d, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            yield lo + d, w.hash[a:b]


def _anchors(docs: DataFrame, plan: Plan, parts: int) -> DataFrame:
    """Packed (hash, doc_id) by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernels.sliced(batches, "text"):
            ids = b.column(0).to_pylist()
            hashes, owners = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for row, words in _texts(b.column(1)):
                h = np.unique(slices(words, plan)[0])
                hashes.append(h)
                owners.append(np.full(len(h), ids[row], np.int64))
            h, o = np.concatenate(hashes), np.concatenate(owners)
            yield packed.batch(packed.by_part(0, h, parts, [h, o]))

    return docs.mapInArrow(run, packed.SCHEMA)


def _shared_anchors(df: DataFrame) -> DataFrame:
    """(id, hash) for hashes of two documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, owners = [], []
        for b in batches:
            hashes += b.column(4).to_pylist()
            owners += b.column(5).to_pylist()
        h, o = packed.cat(hashes, U), packed.cat(owners, np.int64)
        if not len(h):
            return
        by = np.lexsort((o, h))
        h, o = h[by], o[by]
        once = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
        h, o = h[once], o[once]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        n = np.diff(np.append(start, len(h)))
        keep = np.repeat(n > 1, n)
        h, o = h[keep], o[keep]
        for i in range(0, len(h), 1 << 18):
            s = slice(i, i + (1 << 18))
            yield pa.RecordBatch.from_pydict({"id": o[s], "hash": h[s].view(np.int64)})

    return df.mapInArrow(run, "id bigint, hash bigint")


SLICES = "part int, hash bigint, words binary, ids binary, starts binary"


def _sent(docs: DataFrame, plan: Plan, parts: int) -> DataFrame:
    """Slices of the shared hashes; a slice that a batch has several times is one row with all its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernels.sliced(batches, "text"):
            ids, wanted = b.column("id").to_pylist(), b.column("hashes")
            found: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
            for row, words in _texts(b.column("text")):
                h, a, e = slices(words, plan)
                want = np.asarray(wanted[row].values).view(U)
                for i in np.flatnonzero(np.isin(h, want)).tolist():
                    part = (words[a[i] : e[i] + plan.min_words - 1] >> U(32)).astype(np.uint32)
                    found.setdefault((int(h[i]), part.tobytes()), []).append((ids[row], int(a[i])))
            keys = np.array([k[0] for k in found], U)
            places = [np.array(v, np.int64).reshape(-1, 2) for v in found.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((kernels.mix(keys) % U(parts)).astype(np.int32)),
                    pa.array(keys.view(np.int64)),
                    pa.array([k[1] for k in found], pa.binary()),
                    pa.array([p[:, 0].tobytes() for p in places], pa.binary()),
                    pa.array([p[:, 1].tobytes() for p in places], pa.binary()),
                ],
                names=["part", "hash", "words", "ids", "starts"],
            )

    return docs.mapInArrow(run, SLICES)


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of some word sequences, with suffix samples at the ends of runs.

    `symbol` and `length` of each run; `head`, `tail`: suffix position at its first and last row; `same`: the
    common prefix of a run's last row with the next run's first.  Everything else comes from these, in text order.
    """

    def __init__(self, sequences: list[np.ndarray]):
        m = len(sequences)
        sizes = np.array([len(s) for s in sequences], np.int64)
        ends = np.cumsum(sizes + 1)
        text = np.empty(int(ends[-1]), np.int64)
        _, coded = np.unique(np.concatenate(sequences), return_inverse=True)
        stop = ends - 1
        mask = np.ones(len(text), bool)
        mask[stop] = False
        text[mask] = coded + m
        text[stop] = np.arange(m)  # a separator of its own for each, below all words
        self.stop, self.sizes, self.n = stop, sizes, len(text)
        order = self._suffixes(text)
        before = text[order - 1]
        first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        self.symbol = before[first]
        self.length = np.diff(np.append(first, len(text)))
        self.head, self.tail = order[first], order[first + self.length - 1]
        del order, before
        self.same = self._compare(text, self.head[1:], self.tail[:-1])

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling."""
        n, step = len(text), 1
        rank = text
        while True:
            key = rank * (int(rank.max()) + 2)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            k = key[order]
            new = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
            rank = np.empty(n, np.int64)
            rank[order] = new
            step *= 2
            if new[-1] == n - 1 or step >= n:
                return order

    @staticmethod
    def _compare(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of the suffixes at a and b."""
        n, same, live, depth = len(text), np.zeros(len(a), np.int64), np.arange(len(a)), 0
        while len(live):
            x, y = a[live] + depth, b[live] + depth
            ok = (x < n) & (y < n)
            ok[ok] = text[x[ok]] == text[y[ok]]
            live = live[ok]
            depth += 1
            same[live] = depth
        return same

    def _stream(self, at: np.ndarray, value: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From samples at some text positions: common prefix with, and position of, the neighbour of every text position."""
        by = np.argsort(at)
        at, value, other = at[by], value[by], other[by]
        place = np.arange(self.n)
        j = np.searchsorted(at, place, "right") - 1
        past = place - at[j]
        got = np.where(j >= 0, np.maximum(value[j] - past, 0), 0)
        return got, np.where(got > 0, other[j] + past, place)

    def before(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each text position, the common prefix with the suffix before it in order, and where that is (itself if nothing is common)."""
        return self._stream(self.head, np.concatenate([[0], self.same]), np.concatenate([[self.head[0]], self.tail[:-1]]))

    def after(self) -> tuple[np.ndarray, np.ndarray]:
        """The same for the suffix after it."""
        return self._stream(self.tail, np.append(self.same, 0), np.append(self.head[1:], self.tail[-1]))

    def matching_statistics(self) -> np.ndarray:
        """Of each text position, the longest prefix that occurs elsewhere in the collection."""
        return np.maximum(self.before()[0], self.after()[0])


def marks(sequences: list[np.ndarray], least: np.ndarray, most: np.ndarray, min_words: int) -> list[np.ndarray]:
    """For each sequence, the starts of its windows that another document has; least, most: its documents' smallest and largest id."""
    index = RunIndex(sequences)
    long = index.matching_statistics() >= min_words
    owner = np.repeat(np.arange(len(sequences)), index.sizes + 1)
    common, neighbour = index.before()
    top = np.where(common >= min_words, neighbour, np.arange(index.n))  # each class has one position that leads to no other
    while not np.array_equal(up := top[top], top):
        top = up
    lo, hi = np.full(index.n, np.iinfo(np.int64).max), np.full(index.n, np.iinfo(np.int64).min)
    np.minimum.at(lo, top, least[owner])
    np.maximum.at(hi, top, most[owner])
    across = (lo != hi)[top]
    at = np.arange(index.n) - np.repeat(np.concatenate([[0], index.stop[:-1] + 1]), index.sizes + 1)
    fits = at + min_words <= index.sizes[owner]
    hit = np.flatnonzero(across & fits & (long | (least != most)[owner]))
    bounds = np.searchsorted(owner[hit], np.arange(len(sequences) + 1))
    return [at[hit[a:b]] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _spans(df: DataFrame, plan: Plan) -> DataFrame:
    """(id, s, e) of the marked windows of each slice's places."""

    def one(group: dict[tuple[int, bytes], list[tuple[bytes, bytes]]]) -> pa.RecordBatch:
        seqs = [np.frombuffer(w, np.uint32) for _, w in group]
        ids = [packed.cat([p[0] for p in v], np.int64) for v in group.values()]
        starts = [packed.cat([p[1] for p in v], np.int64) for v in group.values()]
        found = marks(seqs, np.array([i.min() for i in ids]), np.array([i.max() for i in ids]), plan.min_words)
        out_id, out_s, out_e = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, s, hit in zip(ids, starts, found, strict=True):
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > plan.min_words)
                a, b = hit[np.concatenate([[0], cut + 1])], hit[np.append(cut, len(hit) - 1)] + plan.min_words
                out_id.append(np.repeat(i, len(a)))
                out_s.append((s[:, None] + a).ravel())
                out_e.append((s[:, None] + b).ravel())
        return pa.RecordBatch.from_pydict({"id": np.concatenate(out_id), "s": np.concatenate(out_s), "e": np.concatenate(out_e)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[tuple[int, bytes], list[tuple[bytes, bytes]]] = {}
        words, last = 0, None
        for b in batches:
            for h, w, i, s in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
                if words >= plan.index_words and h != last:
                    yield one(group)
                    group, words = {}, 0
                last = h
                places = group.get((h, w))
                if places is None:
                    group[h, w] = [(i, s)]
                    words += len(w) // 4
                else:
                    places.append((i, s))
        if group:
            yield one(group)
        kernels.release()

    return df.mapInArrow(run, "id bigint, s bigint, e bigint")


def shared_passages(docs: DataFrame, plan: Plan = Plan(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start_word, end_word): see the module's text."""
    spark = docs.sparkSession
    d = docs.where(F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(size / (16 << 20)))
    common = shared.checkpoint(_shared_anchors(packed.exchange(_anchors(d, plan, parts), parts)))
    wanted = common.groupBy("id").agg(F.collect_list("hash").alias("hashes"))
    # texts without a shared hash needn't move: told by their ids where these are few enough to broadcast
    some = shared.small(common.select("id").distinct(), 16)
    sent = _sent(d.join(some, "id", "left_semi").join(wanted, "id").select("id", "text", "hashes"), plan, parts)
    spans = _spans(packed.exchange(sent, parts).sortWithinPartitions("hash"), plan)
    by = Window.partitionBy("id").orderBy("s", "e")
    far = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.distinct().withColumn("new", F.when(F.col("s") <= far, 0).otherwise(1)).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(F.col("id").alias("doc_id"), "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word")).drop("island")
