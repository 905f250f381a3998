"""URL filter against a large list: a sorted array of 64-bit xxhash keys, memory-mapped and probed by binary search.

An entry is a domain (blocks its sub-domains too), a host with a path, or a whole address with its
query; scheme, port, fragment, a leading "www." and letter case of the host don't matter.  A URL is
probed as its whole address, without its query, and as its host and each parent domain of two labels
or more; the first of these, in this order, that is an entry is its match.  A key that is found is
confirmed against the stored string, so a collision of keys blocks nothing.

The list is written once, in shards by leading key bits, to the folder that all executors share;
each worker maps the shards it meets.  The driver never holds it, and it may have billions of rows.

Nulls: a null URL is not blocked and has no match; null and empty entries are none.  Repeated entries
count once; repeated pages each have their row.  Very long URLs are probed whole.  Extra columns
stay; those named like the results are replaced.  An empty table or list is fine.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Domains of the default list.
DOMAINS = tuple(f"{name}.example.{tld}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for tld in ("com", "net", "org"))
#: Entries of one shard, about.
SHARD_ROWS = 4_000_000


def bare(url: str | Column) -> Column:
    """Host in lower case, path and query of an address."""
    c = F.col(url) if isinstance(url, str) else url
    c = F.regexp_replace(F.trim(c), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    c = F.regexp_replace(F.regexp_replace(c, "#.*$", ""), "^[^/?]*@", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(c, "^[^/?]*", 0)), ":[0-9]*$", "")
    rest = F.regexp_replace(F.regexp_extract(c, "^[^/?]*(.*)$", 1), "^/$", "")
    return F.concat(F.regexp_replace(host, "^www\\.", ""), rest)


def probes(url: str) -> Column:
    """Strings under which a URL may be listed, most specific first."""
    whole = bare(url)
    host = F.regexp_extract(whole, "^[^/?]*", 0)
    labels = F.split(host, "\\.")
    n = F.size(labels)
    parents = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array(host))
    return F.array_distinct(F.concat(F.array(whole, F.regexp_replace(whole, "\\?.*$", "")), parents))


def _write(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Files of one shard; a second attempt of the task replaces them by the same bytes."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    for kind, a in arrays.items():
        temp = f"{path}/.{name}.{kind}.{uuid.uuid4().hex}"
        with fs.open_output_stream(temp) as f:
            f.write(memoryview(np.ascontiguousarray(a)).cast("B") if len(a) else b"")
        fs.move(temp, f"{path}/{name}.{kind}")


def build(entries: DataFrame, column: str = "entry") -> tuple[str, int]:
    """(folder, shards) of the digest array of the entries."""
    e = entries.where(F.col(column).isNotNull()).select(bare(column).alias("entry")).where("entry <> ''").distinct()
    n = e.count()
    bits = max(0, (n // SHARD_ROWS).bit_length())
    folder = shared.new_folder(entries.sparkSession, "digests")
    key = F.xxhash64("entry")
    part = F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, shard = [np.zeros(0, np.uint64)], [], None
        for b in batches:
            if b.num_rows:
                shard = b.column(2)[0].as_py()
                keys.append(b.column(1).to_numpy().view(np.uint64))
                words += [w.encode() for w in b.column(0).to_pylist()]
        if shard is not None:
            k = np.concatenate(keys)
            order = np.argsort(k, kind="stable")
            words = [words[i] for i in order]
            ends = np.cumsum([0, *map(len, words)]).astype(np.int64)
            _write(folder, str(shard), {"keys": k[order], "ends": ends, "text": np.frombuffer(b"".join(words), np.uint8)})
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(map(len, keys))], pa.int64())})

    rows = e.select("entry", key.alias("key"), part.alias("part")).repartitionById(1 << bits, F.col("part")).mapInArrow(run, "n bigint")
    assert sum(r["n"] for r in rows.collect()) == n
    return folder, bits


class DigestArray:
    """The shards of a folder, mapped on first use; read whole where the folder isn't on a mounted file system."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits, self.shards = folder, bits, {}

    def _load(self, name: str, kind: str, dtype) -> np.ndarray:
        if (path := shared.local_path(self.folder)) is not None:
            file = os.path.join(path, f"{name}.{kind}")
            if not os.path.exists(file) or not os.path.getsize(file):
                return np.zeros(0, dtype)
            return np.memmap(file, dtype, "r")
        fs, path = pafs.FileSystem.from_uri(self.folder)
        if fs.get_file_info(f"{path}/{name}.{kind}").type == pafs.FileType.NotFound:
            return np.zeros(0, dtype)
        with fs.open_input_file(f"{path}/{name}.{kind}") as f:
            return np.frombuffer(f.read(), dtype)

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if i not in self.shards:
            self.shards[i] = self._load(str(i), "keys", np.uint64), self._load(str(i), "ends", np.int64), self._load(str(i), "text", np.uint8)
        return self.shards[i]

    def holds(self, keys: np.ndarray, words: list[str]) -> np.ndarray:
        """Whether each word, whose key is given, is an entry."""
        out = np.zeros(len(keys), bool)
        which = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        for s in np.unique(which).tolist():
            stored, ends, text = self.shard(s)
            at = np.flatnonzero(which == s)
            place = np.searchsorted(stored, keys[at])
            while len(at):  # entries of one key stand side by side; each is compared in turn
                near = place < len(stored)
                at, place = at[near], place[near]
                near = stored[place] == keys[at]
                at, place = at[near], place[near]
                same = np.array([text[ends[p] : ends[p + 1]].tobytes() == words[i].encode() for i, p in zip(at.tolist(), place.tolist(), strict=True)], bool)
                out[at[same]] = True
                at, place = at[~same], place[~same] + 1
        return out


_OPEN: dict[str, DigestArray] = {}


def mark(pages: DataFrame, entries: DataFrame, url: str = "url") -> DataFrame:
    """pages with `blocked` and `entry`, the list's string that the URL matched."""
    folder, bits = build(entries)
    kept = shared.besides(pages.schema.fields, "blocked", "entry")
    names = [f.name for f in kept]
    probed_as, keyed_as = shared.fresh(names, "probes", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if folder not in _OPEN:
            _OPEN[folder] = DigestArray(folder, bits)
        for b in batches:
            lists = b.column(probed_as)
            words = lists.flatten().to_pylist()
            keys = b.column(keyed_as).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            hit = _OPEN[folder].holds(keys, words)
            size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
            row = np.repeat(np.arange(b.num_rows), size)
            found = np.flatnonzero(hit)[::-1]  # the first of a row is written last
            entry = np.full(b.num_rows, None, object)
            entry[row[found]] = [words[i] for i in found]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([x is not None for x in entry]), pa.array(list(entry), pa.string())], names=[*names, "blocked", "entry"])

    probed = pages.select(*names, probes(url).alias(probed_as)).withColumn(keyed_as, F.transform(probed_as, lambda x: F.xxhash64(x)))
    return probed.mapInArrow(run, T.StructType([*kept, T.StructField("blocked", T.BooleanType()), T.StructField("entry", T.StringType())]))


def default_entries(pages: DataFrame) -> DataFrame:
    return pages.sparkSession.createDataFrame([(d,) for d in DOMAINS], "entry string")
