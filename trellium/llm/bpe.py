"""Byte-level byte-pair encoding: exact encoder by backtracking, decoder, and a counter by heap merging.

Both take any vocabulary given as ranks (token bytes to rank, lower merges first, single bytes
included), and both work on pretokens (see `pretokens`).  A text's pretokens are found and keyed
with array passes; only a pretoken that a worker has not met before goes through Python.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa

from . import kernels, pretokens

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A worker forgets its pretokens when it holds so many; they are worked out anew, so results don't depend on it.
KEEP = 150_000
#: Bytes of text whose pretokens are looked up together, and bytes of one round of array passes.
ROUND, INNER = 1 << 18, 1 << 17


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """Token bytes by rank, from lines of base64 token and rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks must be 0 to {len(ranks) - 1}")
    return [ranks[i] for i in range(len(ranks))]


class Backtracker:
    """Exact BPE in time linear in the pretoken, without running merges.

    An Aho-Corasick automaton over the tokens (bytes as Latin-1) gives the longest token at each
    position.  The encoder takes it, falls back to ever shorter tokens while the pair with the
    token before would have been merged otherwise, and steps back when none fits.  A position that
    failed is never tried again.  Whether two tokens may stand side by side is a property of the
    pair alone, so it is memoised.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.size = [len(t) for t in tokens]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [self._shorter(t) for t in tokens]
        self.fits: dict[tuple[int, int], bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = []
        for i, t in enumerate(tokens):
            self.parts.append(self._parts(i, t))
        if missing := [b for b in range(256) if bytes([b]) not in self.ids]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")

    def _shorter(self, t: bytes) -> int:
        ids = self.ids
        for n in range(len(t) - 1, 0, -1):
            if (x := ids.get(t[:n])) is not None:
                return x
        return -1

    def _parts(self, i: int, t: bytes) -> tuple[int, int]:
        """The two tokens whose merge makes token i; (i, i) for a token that no merge makes."""
        left = self.shorter[i]
        while left >= 0:
            right = self.ids.get(t[self.size[left] :], -1)
            if 0 <= right < i and left < i and self._fit(left, right):
                self.merged[left, right] = i
                return left, right
            left = self.shorter[left]
        return i, i

    def _fit(self, a: int, b: int) -> bool:
        """True if merging would leave a and b apart: undo merges on both sides of the border, latest first."""
        limit = 1 << 62
        while True:
            if self.merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = a, self.parts[a][1]
                if a == limit:
                    limit, b = b + 1, self.parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.parts[b][0]
                if b + 1 == limit:
                    limit, a = a, self.parts[a][1]
                    if a == limit:
                        return True

    def encode(self, word: bytes) -> list[int]:
        if (whole := self.ids.get(word)) is not None:
            return [whole]
        n, size, shorter, fits = len(word), self.size, self.shorter, self.fits
        longest = [-1] * (n + 1)
        for end, i in self.automaton.iter(word.decode("latin-1")):
            longest[end + 1 - size[i]] = i
        out: list[int] = []
        alive = bytearray(b"\1") * (n + 1)
        at, token = 0, longest[0]
        while at < n:
            before = out[-1] if out else -1
            while True:
                end = at + size[token]
                if alive[end]:
                    if before < 0:
                        ok = True
                    elif (ok := fits.get((before, token))) is None:
                        if len(fits) > 50_000:
                            fits.clear()
                        ok = fits[before, token] = self._fit(before, token)
                    if ok:
                        out.append(token)
                        at, token = end, longest[end]
                        break
                if shorter[token] >= 0:
                    token = shorter[token]
                else:
                    alive[at] = 0
                    token = out.pop()
                    at -= size[token]
                    break
        return out


class HeapMerger:
    """Number of tokens of a pretoken: symbols in a doubly linked list, adjacent pairs in a heap by rank.

    The pair of lowest rank (leftmost of equals) is merged again and again; entries whose symbols
    have changed since they were pushed are stale and skipped.  The count is the number of initial
    symbols less the number of merges; tokens are never listed.
    """

    def __init__(self, tokens: list[bytes]):
        self.ids = {t: i for i, t in enumerate(tokens)}

    def count(self, word: bytes) -> int:
        n, ids = len(word), self.ids
        if n < 2 or word in ids:
            return min(n, 1)
        after, ends = list(range(1, n + 1)), list(range(1, n + 1))
        prior = list(range(-1, n - 1))
        heap = []
        get = ids.get
        for i in range(n - 1):
            if (r := get(word[i : i + 2])) is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        pop, push, merges = heapq.heappop, heapq.heappush, 0
        while heap:
            _, i, end = pop(heap)
            j = after[i]
            if j >= n or ends[i] > j or ends[j] != end:
                continue
            merges += 1
            k = after[j]
            ends[i], after[i], after[j] = end, k, n
            ends[j] = 0
            if k < n:
                prior[k] = i
                if (r := get(word[i : ends[k]])) is not None:
                    push(heap, (r, i, ends[k]))
            if (p := prior[i]) >= 0 and (r := get(word[p:end])) is not None:
                push(heap, (r, p, end))
        return n - merges


class Known:
    """Results for the pretokens met so far, by 64-bit key, in flat arrays: `ids[first[i]:first[i] + size[i]]`, or `size` alone.

    Each is kept with a second, independent hash.  A pretoken that meets another's key but not its
    second hash is worked out by itself and not kept.
    """

    def __init__(self, work: Callable[[bytes], object], listed: bool):
        self.work, self.listed = work, listed
        self.clear()

    def clear(self) -> None:
        self.index: dict[int, int] = {}
        self.check = np.zeros(0, np.uint64)
        self.size = np.zeros(0, np.int64)
        self.first = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0

    def _add(self, results: list, checks: np.ndarray) -> np.ndarray:
        """Places of new results."""
        at = np.arange(len(self.size), len(self.size) + len(results))
        size = np.fromiter(map(len, results), np.int64, len(results)) if self.listed else np.array(results, np.int64)
        self.size, self.check = np.concatenate([self.size, size]), np.concatenate([self.check, checks])
        if self.listed:
            total = int(size.sum())
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(results), np.int32, total)
            self.first = np.concatenate([self.first, self.used + np.cumsum(size) - size])
            self.used += total
        return at

    def of(self, keys: np.ndarray, checks: np.ndarray, word_of: Callable[[int], bytes]) -> np.ndarray:
        """Place of each key's result; word_of(i) gives the bytes behind keys[i]."""
        if len(self.size) > KEEP:
            self.clear()
        get = self.index.get
        at = np.array([get(k, -1) for k in keys.tolist()], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._add([self.work(word_of(i)) for i in new.tolist()], checks[new])
            self.index.update(zip(keys[new].tolist(), at[new].tolist(), strict=True))
        other = np.flatnonzero(self.check[at] != checks)
        if len(other):
            at[other] = self._add([self.work(word_of(i)) for i in other.tolist()], checks[other])
        return at


class Codec:
    """Whole Arrow columns at a time.  One lives in each Python worker and vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.blob = pa.array(tokens, pa.large_binary())

    @cached_property
    def encoder(self) -> Known:
        return Known(Backtracker(self.tokens).encode, True)

    @cached_property
    def counter(self) -> Known:
        return Known(HeapMerger(self.tokens).count, False)

    def pieces(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable[[int], bytes]]]:
        """Rounds of: first text, its bytes and those after, pretokens of each text, start and code of each pretoken, keys and second hashes by code, word of a code."""
        for lo, hi in kernels.rounds(offsets, ROUND):
            part, starts, keys, checks = raw[offsets[lo] : offsets[hi]], [], [], []
            if not len(part):
                continue
            for a, b in kernels.rounds(offsets[lo : hi + 1], INNER):
                base = offsets[lo + a] - offsets[lo]
                start, key, check = _keyed(raw[offsets[lo + a] : offsets[lo + b]], offsets[lo + a : lo + b + 1] - offsets[lo + a])
                starts.append(start + base)
                keys.append(key)
                checks.append(check)
            start, key, check = np.concatenate(starts), np.concatenate(keys), np.concatenate(checks)
            codes, unique = pd.factorize(key)
            example = _first_of(codes, len(unique))
            if not np.array_equal(check[example][codes], check):  # two pretokens of one key
                codes = np.unique(np.stack([key, check], axis=1), axis=0, return_inverse=True)[1].ravel()
                example = _first_of(codes, int(codes.max()) + 1)
                unique = key[example]
            ends = np.append(start[1:], len(part))
            begin, end, held = start[example].tolist(), ends[example].tolist(), part.tobytes()
            local = offsets[lo : hi + 1] - offsets[lo]
            first = np.searchsorted(start, local)
            yield lo, part, np.diff(first), start, codes, unique, check[example], lambda i, h=held, x=begin, y=end: h[x[i] : y[i]]

    def count(self, col: pa.Array) -> pa.Array:
        """Tokens of each text; null stays null."""
        raw, offsets = kernels.text_buffers(col)
        total = np.zeros(len(offsets) - 1, np.int64)
        for lo, _, words, _, codes, unique, check, word in self.pieces(raw, offsets):
            each = self.counter.of(unique, check, word)
            each = self.counter.size[each][codes]
            total[lo : lo + len(words)] = _sums(each, words)
        return pa.array(total, mask=_nulls(col))

    def encode(self, col: pa.Array) -> pa.Array:
        """Ids of each text as a list; null stays null, an empty text has none."""
        raw, offsets = kernels.text_buffers(col)
        sizes, flat = np.zeros(len(offsets) - 1, np.int64), [np.zeros(0, np.int32)]
        for lo, part, words, start, codes, unique, check, word in self.pieces(raw, offsets):
            known = self.encoder
            at = known.of(unique, check, word)[codes]
            each = known.size[at]
            lists = pa.ListArray.from_arrays(pa.array(np.append(known.first, known.used).astype(np.int32)), pa.array(known.ids[: known.used]))
            out = lists.take(pa.array(at)).flatten().to_numpy()
            if not np.array_equal(self.bytes_of(out), part):  # both hashes met: each pretoken by itself
                held, ends = part.tobytes(), np.append(start[1:], len(part))
                alone = [known.work(held[a:b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)]
                each, out = np.array([len(x) for x in alone], np.int64), np.array(list(chain.from_iterable(alone)), np.int32)
            flat.append(out)
            sizes[lo : lo + len(words)] = _sums(each, words)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(flat)), mask=pa.array(_nulls(col)) if col.null_count else None)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        got = self.blob.take(pa.array(ids))
        data = got.buffers()[2]
        return np.frombuffer(data, np.uint8)[: int(self.size[ids].sum())] if data is not None else np.zeros(0, np.uint8)

    def decode(self, col: pa.Array) -> pa.Array:
        """Texts of lists of ids; null stays null.  Ids that don't make UTF-8 give U+FFFD in place of what is broken."""
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        ids = col.flatten().to_numpy(zero_copy_only=False)
        n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        joined = self.bytes_of(ids)
        byte_ends = np.concatenate([[0], np.cumsum(self.size[ids])])[ends]
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(col), [None, pa.py_buffer(byte_ends), pa.py_buffer(joined)])
        try:
            out = texts.cast(pa.large_string())
        except pa.ArrowInvalid:
            out = pa.array([b.decode("utf-8", "replace") for b in texts.to_pylist()], pa.large_string())
        return pa.compute.if_else(pa.compute.is_valid(col), out, None) if col.null_count else out


def _nulls(col: pa.Array) -> np.ndarray:
    return np.asarray(pa.compute.is_null(col))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive values, counts[0] of them, then counts[1] and so on."""
    done = np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(counts)])]
    return np.diff(done)


def _first_of(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n codes stands first."""
    out = np.zeros(n, np.int64)
    out[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return out


def _keyed(part: np.ndarray, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, keys and second hashes of the pretokens of some texts."""
    if not len(part):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if part.max() < 128:
        start = pretokens.split(part, local)
    else:
        points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        byte_at = np.flatnonzero((part & 0xC0) != 0x80)
        start = byte_at[pretokens.split(points, np.searchsorted(byte_at, local))]
    size = np.diff(np.append(start, len(part)))
    place = np.arange(len(part), dtype=np.int32) - np.repeat(start.astype(np.int32), size)
    key, check = (kernels.mix(np.add.reduceat(kernels.letter_hashes(part, place, i), start) + size.astype(np.uint64)) for i in (0, 1))
    return start, key, check


HELD = "bpe"
_BY_NAME: dict[str, Codec] = kernels.held(HELD)


def worker_codec(name: str, tokens: Callable[[], list[bytes]]) -> Codec:
    """The codec that this worker keeps under a name, made on first use."""
    if name not in _BY_NAME:
        _BY_NAME.clear()
        _BY_NAME[name] = Codec(tokens())
    return _BY_NAME[name]
