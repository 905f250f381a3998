"""Column kernels over Arrow text batches: word spans, word hashes, n-gram hashes.

They work on the UTF-8 bytes of a whole batch at once, so a batch costs a handful of array
passes and no Python loop over words.  Words are maximal runs of bytes other than ASCII white
space.  Hashes are 64-bit; equal word sequences always have equal hashes, and different ones the
same hash only by chance, about one pair in 2^64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that one round of array passes takes; a longer text is a round of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of text whose words are hashed together; for a moment that takes many times as much.
HASHED_BYTES = 1 << 18
#: Bytes of text in one batch that a worker hands back.
SLICE_BYTES = 4 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


#: Random words by place (of 64) and byte, for two independent hashes.
_TABLES = [mix(np.arange(64 * 256, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) for seed in (0x1D8AF066, 0x6A09E667F3BCC909)]


def letter_hashes(letters: np.ndarray, place: np.ndarray, which: int = 0) -> np.ndarray:
    """A random word for each byte at its place in a token; their sum is the token's hash.

    Words come from a table, and beyond 64 places from it and the number of the block of 64, so no
    arrangement of letters makes two tokens meet as it would with powers of a base.
    """
    h = _TABLES[which][((place & 63) << 8) | letters]
    far = np.flatnonzero(place > 63)
    if len(far):
        h[far] = mix(h[far] + (place[far] >> 6).astype(U) * U(0xD6E8FEB86659FD93))
    return h


#: What operators hold in a worker from task to task, by the operators' names.
_HELD: dict[str, dict] = {}


def held(name: str) -> dict:
    """A dict that lasts in this worker until a task ends that has no use for it."""
    return _HELD.setdefault(name, {})


def release(keep: str = "") -> None:
    """Gives back to the system what this worker has freed, and what it holds for others than `keep`; called when a task's rows are done."""
    for name, things in _HELD.items():
        if name != keep:
            things.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column, without copying where Arrow allows it; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    n = len(col)
    if off is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, kind, count=n + 1, offset=col.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def rounds(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """[lo, hi) ranges of rows that together hold about `limit` bytes; every row is in exactly one."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def sliced(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of one column, so that what is made of them stays small."""
    for batch in batches:
        size = batch.column(column).nbytes
        step = max(1, int(batch.num_rows * limit / max(size, 1)))
        for i in range(0, max(batch.num_rows, 1), step):
            yield batch.slice(i, step)


class Words:
    """Words of some consecutive texts: `start` and `size` in bytes, `hash`, and `first[d]:first[d+1]` for text d."""

    __slots__ = ("first", "hash", "size", "start")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        solid = ~_SPACE[raw]
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        heads = offsets[:-1][offsets[1:] > offsets[:-1]]
        opens[heads] = solid[heads]
        self.start = np.flatnonzero(opens)
        self.first = np.searchsorted(self.start, offsets)
        if not len(self.start):
            self.size, self.hash = np.zeros(0, np.int64), np.zeros(0, U)
            return
        at = np.cumsum(solid)[self.start] - 1
        letters = raw[solid]
        self.size = np.diff(np.append(at, len(letters)))
        place = np.arange(len(letters)) - np.repeat(at, self.size)
        self.hash = mix(np.add.reduceat(letter_hashes(letters, place), at) + self.size.astype(U))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; the last n - 1 positions have none."""
    if len(words) < n:
        return np.zeros(0, U)
    m = len(words) - n + 1
    h = words[:m].copy()
    for j in range(1, n):
        h *= U(0xD6E8FEB86659FD93)
        h += words[j : j + m]
    return mix(h)


def per_text_ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): n-grams that don't cross texts; a text of 1 to n - 1 words gives its whole as one gram."""
    count = w.counts()
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(grams)])
    out = np.empty(first[-1], U)
    whole = np.zeros(len(w.hash), bool)
    if n <= len(w.hash):
        whole[: len(w.hash) - n + 1] = True
    for d in np.flatnonzero(count):
        a, b = w.first[d], w.first[d + 1]
        whole[max(a, b - n + 1) : b] = False
    every = ngrams(w.hash, n)
    long = np.repeat(count >= n, grams)
    out[long] = every[whole[: len(every)]]
    for d in np.flatnonzero((count > 0) & (count < n)):
        a, b = w.first[d], w.first[d + 1]
        h = np.array([b - a], U)
        for i in range(a, b):
            h = mix(h * U(0xD6E8FEB86659FD93) + w.hash[i : i + 1])
        out[first[d]] = h[0]
    return out, first


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    if len(h) < w:
        return h[:0]
    m, size = h, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = w - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
