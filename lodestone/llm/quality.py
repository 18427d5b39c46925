"""Quality selection by importance resampling over hashed n-gram models.

Two bags are counted over hashed byte 4-grams (digits folded to one) and over whether a
word repeats the one before it: one of all raw documents, one of the target documents, a
bounded sample of those labelled good. A document's importance weight is the sum of
log((target + m) / (expected under raw + m)) over its n-grams, kept in fixed point so that
sums do not depend on partitions. Selection is Gumbel top-k: weight / temperature plus
Gumbel noise drawn from a hash of the row, the k largest stay, which samples without
replacement in proportion to the weights to the power 1 / temperature. At the temperature
of 0.25 that is the fourth power, which is close to a plain threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialize

#: At most so many labelled documents are used, those whose ids have the least hashes.
SAMPLE = 20_000
BUCKETS = 1 << 16
SMOOTH, TEMPERATURE, FIXED = 10.0, 0.25, 1 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x30:0x3A] = 0x30


def _features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of about ``tk.BLOCK`` bytes, of several texts or of one: first and end row,
    a bucket for each position (-1: none) and for each word, and where each text's part of
    both begins (n + 1 entries). Grams and pairs that begin in a piece may end beyond it."""
    data, offsets = tk.utf8(column)
    tail: tuple[int, np.uint64] | None = None  # a text that goes on, and its last word so far
    for lo, hi in tk._pieces(data, offsets, tk.SPACED):
        i, j = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
        at = np.clip(offsets[i : j + 1], lo, hi) - lo
        x = np.zeros(hi - lo + 3, np.uint32)
        seen = _FOLD[data[lo : hi + 3]]
        x[: len(seen)] = seen
        g = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
        bucket = ((g * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
        for back in (1, 2, 3):
            p = offsets[i + 1 : j + 1] - back
            bucket[p[(p >= offsets[i:j]) & (p >= lo) & (p < hi)] - lo] = -1
        h, _, _, first = tk.words(data[lo:hi], at, tk.SPACED, fold=False)
        pair = np.full(len(h), -1, np.int64)
        if len(h):
            pair[1:] = np.where(h[1:] == h[:-1], BUCKETS, BUCKETS + 1)
            pair[first[:-1][first[:-1] < len(h)]] = -1
            if tail and tail[0] == i and first[1] > 0:
                pair[0] = BUCKETS if h[0] == tail[1] else BUCKETS + 1
        if first[-1] > first[-2]:
            tail = (j - 1, h[-1])
        elif tail and tail[0] != j - 1:
            tail = None
        yield i, j, bucket, at, pair, first


@dataclass
class Model:
    weights: np.ndarray  # fixed point, one per bucket
    threshold: float  # on the importance weight; -inf keeps all

    def score(self, column: pa.Array) -> np.ndarray:
        table = np.append(self.weights, 0)  # bucket -1
        out = np.zeros(len(column), np.int64)
        for i, j, bucket, at, pair, first in _features(column):
            part = np.zeros(len(bucket) + 1, np.int64)
            np.cumsum(table[bucket], out=part[1:])
            more = np.zeros(len(pair) + 1, np.int64)
            np.cumsum(table[pair], out=more[1:])
            out[i:j] += part[at[1:]] - part[at[:-1]] + more[first[1:]] - more[first[:-1]]
        return out / FIXED


def _sample(labels: DataFrame) -> DataFrame:
    """A bounded sample of labelled ids; a document labelled twice counts as its worst."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)


def weigh(docs: DataFrame, sample: DataFrame) -> Model:
    """Count both models over all of ``docs(doc_id, text)``; the threshold is still -inf."""
    marked = docs.join(F.broadcast(sample), "doc_id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS + 2, np.int64), np.zeros(BUCKETS + 2, np.int64)
        for b in batches:
            flag = np.array([q == 1 for q in b.column("quality").to_pylist()], bool)
            for i, j, bucket, at, pair, first in _features(b.column("text")):
                raw += np.bincount(bucket + 1, minlength=BUCKETS + 3)[1:] + np.bincount(pair + 1, minlength=BUCKETS + 3)[1:]
                for k in np.flatnonzero(flag[i:j]).tolist():
                    x, y = bucket[at[k] : at[k + 1]], pair[first[k] : first[k + 1]]
                    np.add.at(good, x[x >= 0], 1)
                    np.add.at(good, y[y >= 0], 1)
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "n_raw", "n_good"])

    parts = marked.select("text", "quality").mapInArrow(count, "bucket long, n_raw long, n_good long")
    total = parts.groupBy("bucket").agg(F.sum("n_raw").alias("r"), F.sum("n_good").alias("g")).collect()  # at most BUCKETS + 2 rows
    raw, good = np.zeros(BUCKETS + 2), np.zeros(BUCKETS + 2)
    for row in total:
        raw[row.bucket], good[row.bucket] = row.r, row.g
    weights = np.zeros(BUCKETS + 2)
    for part in (slice(0, BUCKETS), slice(BUCKETS, BUCKETS + 2)):
        expected = raw[part] * (good[part].sum() / max(raw[part].sum(), 1))
        weights[part] = np.log((good[part] + SMOOTH) / (expected + SMOOTH))
    return Model(np.rint(weights * FIXED).astype(np.int64), -math.inf)


def threshold(scores: DataFrame, sample: DataFrame) -> float:
    """Where fewest good documents of the sample fall below (each counts five) and fewest bad
    ones above; -inf without good or without bad ones. The texts are not read again."""
    seen = scores.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("weight").alias("w"), F.min("quality").alias("q"))
    rows = seen.select("w", "q").collect()  # at most SAMPLE rows
    w, q = np.array([r.w for r in rows]), np.array([r.q for r in rows])
    if not (q == 1).any() or not (q != 1).any():
        return -math.inf
    order = np.argsort(w, kind="stable")
    w, q = w[order], q[order]
    lost = np.concatenate([[0], np.cumsum(q == 1)]) * 5.0
    kept = (q != 1).sum() - np.concatenate([[0], np.cumsum(q != 1)])
    cost = lost + kept
    cost[1:-1][w[1:] == w[:-1]] = math.inf
    cut = int(np.argmin(cost))
    return -math.inf if cut == 0 else math.inf if cut == len(w) else float((w[cut - 1] + w[cut]) / 2)


def _key(doc: list, weight: np.ndarray) -> np.ndarray:
    ids = np.array([-1 if d is None else d for d in doc], np.int64).view(np.uint64)
    h = tk.mix(tk.mix(ids) ^ np.rint(weight * FIXED).astype(np.int64).view(np.uint64))
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return weight / TEMPERATURE - np.log(-np.log(u))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = shared.value.score(b.column("text"))
            g = _key(b.column("doc_id").to_pylist(), w)
            yield pa.record_batch([b.column("doc_id"), pa.array(w), pa.array(g)], names=["doc_id", "weight", "gumbel_key"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, weight double, gumbel_key double")


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, exactly: histograms of 4096 bins narrow its range down."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return math.inf
    inside = df
    for _ in range(8):
        width = (high - low) / 4096
        if not width or low + width == low:
            break
        bins = {r[0]: r[1:] for r in inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(4095)).alias("b")).agg(F.count("*"), F.min(column), F.max(column)).collect()}
        for b in sorted(bins, reverse=True):
            n, least, most = bins[b]
            if k <= n:
                low, high = least, most
                break
            k -= n
        inside = inside.where((F.col(column) >= low) & (F.col(column) <= high))
        if n <= 2000 or low == high:
            break
    if low == high:
        return low
    return inside.select(column).orderBy(F.desc(column)).limit(k).agg(F.min(column)).first()[0]


def importance_scores(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model, float]:
    """Scores of all rows, the model, and the Gumbel key of the last row that stays."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = materialize(_sample(labels), "sample")
    model = weigh(docs, sample)
    scores = materialize(_scored(docs, model), "scores")
    model.threshold = threshold(scores, sample)
    k = scores.where(F.col("weight") >= model.threshold).count()
    return scores, model, kth_largest(scores, "gumbel_key", k)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, log_weight, gumbel_key, kept)`` for each row of ``docs(doc_id, text, ...)``.

    k is the number of rows whose weight reaches the fitted threshold. A null, empty or very
    short text has weight 0. Rows with equal id and text get equal keys; rows tied with the
    last one stay too. A null doc_id is scored like any other. An empty table gives an empty
    result; further columns are ignored; labels of unknown documents count for nothing.
    """
    scores, _, last = importance_scores(docs, labels)
    return scores.select("doc_id", F.col("weight").alias("log_weight"), "gumbel_key", (F.col("gumbel_key") >= F.lit(last)).alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; nothing is joined back, since
    a row's key is computed again from the row."""
    _, model, last = importance_scores(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.schema.names.index("doc_id")).cast(pa.int64()).to_pylist()
            key = _key(ids, shared.value.score(b.column(b.schema.names.index("text"))))
            yield b.filter(pa.array(key >= last))

    return docs.mapInArrow(run, docs.schema)
