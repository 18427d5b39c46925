"""op10: scores against a plain version, the cut against a sort, held-out accuracy."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality
from lodestone.llm.queries import op10_quality
from tests.conftest import DATA


def features(text):
    raw = (text or "").encode()
    x = [0x30 if 0x30 <= b <= 0x39 else b for b in raw]
    out = []
    for i in range(len(x) - 3):
        g = x[i] | x[i + 1] << 8 | x[i + 2] << 16 | x[i + 3] << 24
        out.append((g * 2654435761 & 0xFFFFFFFF) >> 16)
    words = raw.split()  # bytes: 0x20 and 0x09-0x0D
    out += [quality.BUCKETS if a == b else quality.BUCKETS + 1 for a, b in zip(words[1:], words[:-1], strict=True)]
    return out


def plain_weights(docs, good):
    raw, target = Counter(), Counter()
    for d, text in docs:
        f = features(text)
        raw.update(f)
        if d in good:
            target.update(f)
    out = {}
    for part in (range(quality.BUCKETS), range(quality.BUCKETS, quality.BUCKETS + 2)):
        share = sum(target[b] for b in part) / max(sum(raw[b] for b in part), 1)
        for b in part:
            out[b] = round(math.log((target[b] + quality.SMOOTH) / (raw[b] * share + quality.SMOOTH)) * quality.FIXED)
    return {d: sum(out[b] for b in features(t)) / quality.FIXED for d, t in docs}


def test_whole_table_weights(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").collect()}
    want, rows = plain_weights(docs, good), op10_quality(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.log_weight == pytest.approx(want[r.doc_id], abs=1e-4), r.doc_id
    kept = sorted((r.gumbel_key for r in rows if r.kept), reverse=True)
    assert kept == sorted((r.gumbel_key for r in rows), reverse=True)[: len(kept)]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    scored = quality.quality_scores(docs, labels.where(half)).join(labels.where(~half), "doc_id")
    rows = scored.select("kept", "quality").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_long_texts_in_pieces_are_counted_whole(monkeypatch):
    texts = [None, "", "a", "one one two", "", "word " * 30 + "word", "x" * 90, "a b\nb  c c", " " * 50, "é è é " * 20 + "12 34", None]
    column = pa.array(texts)
    rng = np.random.default_rng(2)
    model = quality.Model(rng.integers(-9, 9, quality.BUCKETS + 2) * quality.FIXED, 0.0)
    want = [sum(int(model.weights[f]) for f in features(t)) / quality.FIXED for t in texts]
    for block in (1, 3, 7, 40, 1 << 19):
        monkeypatch.setattr(quality.tk, "BLOCK", block)
        assert model.score(column).tolist() == want
    assert model.score(column[:0]).tolist() == []


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=7000).tolist(), [1.0] * 5000 + [2.0] * 10, rng.integers(0, 5, 6000).astype(float).tolist(), [4.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        ordered = sorted(values, reverse=True)
        for k in {k for k in (1, 2, len(values) // 2, len(values)) if 0 < k <= len(values)}:
            assert quality.kth_largest(df, "v", k) == ordered[k - 1]
    assert quality.kth_largest(spark.createDataFrame([], "v double"), "v", 3) == math.inf


def test_gumbel_sampling_prefers_by_weight():
    ids = list(range(20000))
    even = quality._key(ids, np.zeros(len(ids)))
    lifted = quality._key(ids, np.where(np.arange(len(ids)) % 2, quality.TEMPERATURE * math.log(4), 0.0))
    top = np.argsort(-even)[:2000]
    assert 0.45 < (top % 2).mean() < 0.55
    first = np.argsort(-lifted)[:200]
    assert 0.7 < (first % 2).mean() < 0.9  # four to one


def test_odd_rows_stay_whole(spark):
    kind = "doc_id long, text string, weight string, quality int"
    good = "plain sentence about the weather and the river "
    rows = [(i, good * (1 + i % 3), "w", 5) for i in range(20)] + [(i, "$$$ %%% ### " * 9, "w", 5) for i in range(20, 40)]
    rows += [(None, None, None, None), (50, "", "w", 1), (51, "abc", "w", 1), (1, good, "w", 5), (60, "long " * 300000, "w", 1)]
    df = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)] + [(None, 1, 1), (3, 1, None), (999, 0, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(df, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i in range(20)) and not any(by[i].kept for i in range(20, 40))
    assert by[None].log_weight == by[50].log_weight == by[51].log_weight == 0
    kept = quality.keep_quality(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    assert quality.quality_scores(df.limit(0), labels).count() == 0
    assert quality.quality_scores(df, labels.limit(0)).where("kept").count() == len(rows)
