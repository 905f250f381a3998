"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Two generative models count byte 4-grams in hash buckets: one over the target (documents labelled
good and not toxic), one over the raw table, every document of it.  A language that is over- or
under-represented in the target is weighted back to its share of the raw text, so the ratio is
about quality and not about language.  A document's log weight is the log ratio of the two models
for `sharpness` of its 4-grams: their mean log ratio times `sharpness`, so that long and short texts
compare.  Adding Gumbel noise and keeping the k largest draws k documents without replacement in
proportion to their weights; noise comes from a hash of seed and doc_id.

k is the number of documents whose log weight reaches the value that best parts target from other
labelled rows (a target row lost counts as `lost` others kept), each of them scored as if it had no
label: most documents have none, and a text that built the target looks better under it than a like
one that didn't.  Only labels are sampled: at most `label_rows`, those of smallest hash.

Nulls: a null text has no weight and is rejected; a null doc_id has the same noise as any other
null; a null language is a language of its own; a label row with a null is no label.  Texts under
4 bytes, so empty ones too, have log weight 0.  Very long texts count in full.  Labels that repeat a
doc_id make it target only if all do.  Equal keys at the border are all kept, so repeated rows stay
or go together.  Extra columns stay; with `resample`, columns named like the results are replaced,
with `kept` every column comes out as it went in.  Without labels of both kinds nothing can be told
apart, and every document with a text stays.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels, shared, vectors


@dataclass(frozen=True)
class Plan:
    """Production parameters."""

    bits: int = 18
    #: Pseudo-count of each bucket in both models.
    smooth: float = 1.0
    #: 4-grams whose ratio makes a document's weight.
    sharpness: float = 100.0
    #: How many other labelled rows kept weigh as much as one target row lost.
    lost: float = 2.0
    seed: int = 11
    #: The bound of the labelled sample.
    label_rows: int = 200_000


N = 4


def buckets(raw: np.ndarray, bits: int) -> np.ndarray:
    """Hash bucket of the 4 bytes from each position."""
    if len(raw) < N:
        return np.zeros(0, np.uint32)
    x = raw.astype(np.uint32)
    g = x[:-3] | (x[1:-2] << np.uint32(8)) | (x[2:-1] << np.uint32(16)) | (x[3:] << np.uint32(24))
    g *= np.uint32(2654435761)
    g ^= g >> np.uint32(15)
    g *= np.uint32(2246822519)
    return g >> np.uint32(32 - bits)


def _spans(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the first of its 4-grams and the one after its last, among n."""
    return np.minimum(offsets[:-1], n), np.minimum(np.maximum(offsets[1:] - N + 1, offsets[:-1]), n)


def add_counts(acc: np.ndarray, col: pa.Array, weight: np.ndarray, bits: int) -> None:
    """Adds to acc[0] the counts of all texts, to acc[1] those of each times its weight."""
    raw, offsets = kernels.text_buffers(col)
    for lo, hi in kernels.rounds(offsets):
        h = buckets(raw[offsets[lo] : offsets[hi]], bits)
        a, b = _spans(offsets[lo : hi + 1] - offsets[lo], len(h))
        inside = np.repeat(np.tile([0.0, 1.0], hi - lo), np.diff(np.column_stack([a, b]).ravel(), prepend=0))
        own = np.repeat(np.column_stack([np.zeros(hi - lo), weight[lo:hi]]).ravel(), np.diff(np.column_stack([a, b]).ravel(), prepend=0))
        h = h[: len(inside)]
        acc[0] += np.bincount(h, weights=inside, minlength=acc.shape[1])
        some = own > 0
        if some.any():
            acc[1] += np.bincount(h[some], weights=own[some], minlength=acc.shape[1])


def mean_ratio(col: pa.Array, table: np.ndarray, bits: int) -> np.ndarray:
    """Mean log ratio of the 4-grams of each text; 0 where there are none."""
    raw, offsets = kernels.text_buffers(col)
    out = np.zeros(len(offsets) - 1)
    for lo, hi in kernels.rounds(offsets):
        h = buckets(raw[offsets[lo] : offsets[hi]], bits)
        a, b = _spans(offsets[lo : hi + 1] - offsets[lo], len(h))
        some = b > a
        if some.any():  # each text is summed by itself, so equal texts have equal bits wherever they stand
            sums = np.add.reduceat(np.append(table[h], 0.0), np.column_stack([a[some], b[some]]).ravel())[::2]
            out[lo:hi][some] = sums / (b - a)[some]
    return out


def log_ratio(raw: np.ndarray, target: np.ndarray, smooth: float) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), both seen at the target's size."""
    if not target.sum():
        return np.zeros(len(raw), np.float64)
    return np.log((target + smooth) / (raw * (target.sum() / raw.sum()) + smooth))


def sampled_labels(labels: DataFrame, plan: Plan) -> DataFrame:
    """(label_id, good) of at most plan.label_rows documents; good: every label says quality 1 and not toxic."""
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").alias("label_id"))
    rows = rows.agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("good"))
    return F.broadcast(rows.orderBy(F.xxhash64(F.lit(plan.seed), "label_id"), "label_id").limit(plan.label_rows))


def models(docs: DataFrame, labels: DataFrame, plan: Plan, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> tuple[np.ndarray, np.ndarray, dict]:
    """(counts of the raw text, of the target, weight of each language in the target); `labels` from sampled_labels."""
    d = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    d = d.join(labels, F.col("id") == F.col("label_id"), "left").select("text", "lang", F.coalesce("good", F.lit(False)).alias("good"))
    size = F.octet_length("text").cast("double")
    sizes = d.groupBy("lang").agg(F.sum(size).alias("raw"), F.sum(F.when(F.col("good"), size).otherwise(0)).alias("target")).collect()
    all_raw, all_target = sum(r["raw"] for r in sizes), sum(r["target"] for r in sizes)
    weight = {r["lang"]: (r["raw"] / all_raw) / (r["target"] / all_target) for r in sizes if r["target"]}
    n, bits = 1 << plan.bits, plan.bits

    def add(acc: np.ndarray, b: pa.RecordBatch) -> None:
        good = b.column(2).to_pylist()
        w = np.array([weight.get(la, 0.0) if g else 0.0 for la, g in zip(b.column(1).to_pylist(), good, strict=True)])
        add_counts(acc.reshape(2, n), b.column(0), w, bits)

    both = vectors.total(d, 2 * n, add).reshape(2, n)
    return both[0], both[1], weight


def fit(docs: DataFrame, labels: DataFrame, plan: Plan, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> np.ndarray:
    """The log ratio of each bucket; `labels` from sampled_labels."""
    raw, target, _ = models(docs, labels, plan, text, doc_id, lang)
    return log_ratio(raw, target, plan.smooth)


def left_out_ratio(text: bytes, weight: float, raw: np.ndarray, target: np.ndarray, plan: Plan) -> float:
    """The mean log ratio of a text of the target under the models without its label: its own counts leave the target."""
    h = buckets(np.frombuffer(text, np.uint8), plan.bits)
    left = target.sum() - weight * len(h)
    if not len(h) or left <= 0.5:  # no 4-grams, or the target has no other text
        return 0.0
    at, n = np.unique(h, return_counts=True)
    t = np.maximum(target[at] - weight * n, 0.0)
    return float((n * np.log((t + plan.smooth) / (raw[at] * (left / raw.sum()) + plan.smooth))).sum() / len(h))


def left_out(docs: DataFrame, sample: DataFrame, fitted: tuple[np.ndarray, np.ndarray, dict], plan: Plan, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(id, good, log_weight) of the labelled documents, each scored as if it had no label."""
    held = docs.sparkSession.sparkContext.broadcast(fitted)
    d = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    d = d.join(sample, F.col("id") == F.col("label_id")).select("id", "good", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, weight = held.value
        for b in batches:
            rows = zip(b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), strict=True)
            w = [left_out_ratio(t, weight.get(la, 0.0) if g else 0.0, raw, target, plan) * plan.sharpness for g, t, la in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(w, pa.float64())], names=["id", "good", "log_weight"])
        kernels.release()

    return d.mapInArrow(run, T.StructType([d.schema["id"], d.schema["good"], T.StructField("log_weight", T.DoubleType())]))


def _noise(doc_id: str, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def scored(docs: DataFrame, table: np.ndarray, plan: Plan, text: str = "text", doc_id: str = "doc_id", weight: str = "log_weight", key: str = "key") -> DataFrame:
    """docs with log_weight, null for a null text, and key."""
    kept = shared.besides(docs.schema.fields, weight, key)
    names = [f.name for f in kept]
    shared_table = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in kernels.sliced(batches, text):
            col = b.column(text)
            w = pa.array(mean_ratio(col, shared_table.value, plan.bits) * plan.sharpness, mask=np.asarray(pa.compute.is_null(col)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), w], names=[*names, weight])
        kernels.release()

    out = docs.select(names).mapInArrow(run, T.StructType([*kept, T.StructField(weight, T.DoubleType())]))
    return out.withColumn(key, F.col(weight) + _noise(doc_id, plan.seed))


def split_value(labelled: DataFrame, lost: float = 1.0) -> float | None:
    """The log weight that maximises `lost` times the share of good rows at or above it, less that of others; None without both kinds.

    Sought among all rows of the labelled sample, of which there are at most Plan.label_rows.
    """
    rows = np.array([(r["log_weight"], r["good"]) for r in labelled.select("log_weight", "good").collect()], dtype=float).reshape(-1, 2)
    good = rows[:, 1] > 0
    if good.all() or not good.any():
        return None
    values = np.unique(rows[:, 0])
    at = np.concatenate([values, [np.inf]])
    g, o = np.sort(rows[good, 0]), np.sort(rows[~good, 0])
    gain = lost * (len(g) - np.searchsorted(g, at)) / len(g) - (len(o) - np.searchsorted(o, at)) / len(o)
    best = int(gain.argmax())
    return float(at[best]) if best == 0 or best == len(values) else float((at[best] + at[best - 1]) / 2)


#: Ranges into which each pass of kth_largest parts what is left.
BINS = 1024


def kth_largest(df: DataFrame, col: str, k: int) -> float:
    """Exact k-th largest value, 1 <= k <= rows: each pass counts BINS ranges and goes on with the one that holds it, so no rows are sorted."""
    x = F.col(col)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    while lo < hi:
        place = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * BINS), F.lit(BINS - 1))
        bins = df.where(x.between(lo, hi)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
    return lo


def _drawn(docs: DataFrame, labels: DataFrame, plan: Plan, text: str, doc_id: str, lang: str, weight: str, key: str) -> DataFrame:
    sample = sampled_labels(labels, plan)
    fitted = models(docs, sample, plan, text, doc_id, lang)
    out = scored(docs, log_ratio(*fitted[:2], plan.smooth), plan, text, doc_id, weight, key)
    some = out.where(F.col(weight).isNotNull())
    thin = shared.checkpoint(some.select(F.col(weight).alias("w"), F.col(key).alias("key")))
    border = split_value(left_out(docs, sample, fitted, plan, text, doc_id, lang), plan.lost)
    n, k = thin.agg(F.count("*"), F.count(F.when(F.col("w") >= border, 1))).first() if border is not None else (0, 0)
    if k >= n:
        return some
    return out.where(F.col(key) >= (kth_largest(thin, "key", k) if k else float("inf")))


def resample(docs: DataFrame, labels: DataFrame, plan: Plan = Plan(), text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows of docs that stay, with log_weight and key added."""
    return _drawn(docs, labels, plan, text, doc_id, lang, "log_weight", "key")


def kept(docs: DataFrame, labels: DataFrame, plan: Plan = Plan(), text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows of docs that stay, as they were."""
    return _drawn(docs, labels, plan, text, doc_id, lang, *shared.fresh(docs.columns, "log_weight", "key")).select(docs.columns)
