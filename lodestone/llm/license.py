"""License scan by diagonal voting over word k-grams.

All rolling k-gram hashes of a text are compared with those of the templates. A shared gram
at word i of the text and word j of a template votes for the diagonal i - j of that pair; a
copied notice gives many votes on one diagonal, edited words shift it by a few. Votes are
aggregated by diagonal, neighbouring diagonals merged, and a merged span is verified by the
share of the template's words that its grams cover. The share alone would take a notice of
another license for that of a template that differs in one word, so a span must also hold
the words that decide a label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialize

PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
)
#: Words that a span must hold for a label, each in one of its spellings; of these, the ones
#: whose first spelling stands in the template. None is longer than a gram.
DECIDING = {
    "mit": (("deal in",),),
    "apache-2": (("apache",), ("version 2",), ("license 2",)),
    "cc-by-nc": (("by nc",), ("noncommercial", "non commercial")),
    "gpl-3": (("gnu general",), ("version 3",)),
}
K, SLACK, COVER = 3, 3, 0.8
_ROWS = "uid long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, gram long, words string, pos long"


def _hash(text: str) -> np.ndarray:
    return tk.words(*tk.utf8(pa.array([text])), tk.ALNUM)[0]


def _template_grams(templates: tuple, k: int) -> list[tuple]:
    """A row per gram, with bits of the deciding words in it and of all of its template's.

    A gram of another spelling of deciding words decides only; it covers no word."""
    out = []
    for n, (label, text) in enumerate(templates):
        words = text.split()
        asked = [p for p in DECIDING.get(label, ()) if f" {p[0]} " in f" {text} "]
        every = (1 << len(asked)) - 1
        seen = set()
        for said in [text, *(f" {text} ".replace(f" {p[0]} ", f" {x} ").strip() for p in asked for x in p[1:])]:
            own = said.split()
            for j, g in enumerate(tk.grams(_hash(said), k).view(np.int64).tolist()):
                gram = " ".join(own[j : j + k])
                bits = sum(1 << i for i, p in enumerate(asked) if any(f" {x} " in f" {gram} " for x in p))
                if said == text or (bits and gram not in seen):
                    out.append((g, gram, n, label, len(words), j, said == text, bits, every))
                    seen.add(gram)
    return out


def _scan(docs: DataFrame, phrases: tuple, wanted: np.ndarray, k: int) -> DataFrame:
    """One row of base figures per document, and one per gram that some template holds."""
    by_length: dict[int, list] = {}
    for text, label in phrases:
        h = _hash(text)
        by_length.setdefault(len(h), []).append((tk.grams(h, len(h))[0], text, label))
    wanted = np.unique(wanted.view(np.uint64))
    table = np.zeros(1 << 16, bool)
    table[(wanted >> np.uint64(48)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 33, 0
        for whole in batches:
            for part in range(0, whole.num_rows, 1000):
                b = whole.slice(part, 1000)
                data, offsets = tk.utf8(b.column("text"))
                h, start, end, at = tk.words(data, offsets, tk.ALNUM)
                plain = lambda p, n: " ".join(tk.FOLD[data[start[i] : end[i]]].tobytes().decode("utf-8", "replace") for i in range(p, p + n))  # noqa: B023, E731
                places: dict[int, list[int]] = {}
                labels: dict[int, set[str]] = {}
                for n, known in by_length.items():
                    g = tk.grams(h, n)
                    for value, text, label in known:
                        for p in np.flatnonzero(g == value).tolist():
                            r = int(np.searchsorted(at, p, "right")) - 1
                            if p + n <= at[r + 1] and plain(p, n) == text:
                                places.setdefault(r, []).append(p - int(at[r]))
                                labels.setdefault(r, set()).add(label)
                ids = b.column("doc_id").to_pylist()
                rows = []
                for r, doc in enumerate(ids):
                    own = places.get(r, [])
                    rows.append((base + count + r, doc, int(at[r + 1] - at[r]), len(own), min(own, default=None), max(own, default=None), ",".join(sorted(labels.get(r, ()))), None, None, None))
                g = tk.grams(h, k)
                hits = np.flatnonzero(table[(g >> np.uint64(48)).astype(np.int64)])
                hits = hits[np.isin(g[hits], wanted)]
                for p, r in zip(hits.tolist(), (np.searchsorted(at, hits, "right") - 1).tolist(), strict=True):
                    if p + k <= at[r + 1]:
                        rows.append((base + count + r, ids[r], None, None, None, None, None, int(g[p].astype(np.int64)), plain(p, k), p - int(at[r])))
                count += b.num_rows
                kinds = [pa.string() if "string" in f else pa.int64() for f in _ROWS.split(", ")]
                cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in _ROWS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _ROWS)


def scan_licenses(docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, k: int = K, cover: float = COVER) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` per row.

    Words are runs of digits, a-z (A-Z lower-cased) and characters beyond ASCII. Base: all
    places where a phrase's words stand consecutively. The voting adds the label of every
    template of which ``cover`` of the words and all deciding ones are found; score is the largest covered share,
    1 where a phrase stands, else 0 without a vote. A null or empty text has no words, empty
    labels and score 0. Rows with null or repeated ids are scanned each; further columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    grams = _template_grams(templates, k)
    seen = materialize(_scan(docs, phrases, np.array([g[0] for g in grams], np.int64), k), "license")
    known = spark.createDataFrame(grams, "gram long, words string, template int, label string, size int, at long, covers boolean, bits int, every int")
    votes = seen.where("gram is not null").select("uid", "gram", "words", "pos").join(F.broadcast(known), ["gram", "words"])
    key = ["uid", "template", "label", "size", "every"]
    ats = F.collect_set(F.when(F.col("covers"), F.col("at")))
    lines = votes.groupBy(*key, (F.col("pos") - F.col("at")).alias("diagonal")).agg(ats.alias("ats"), F.bit_or("bits").alias("bits"))
    w = Window.partitionBy("uid", "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(w) > SLACK) | F.lag("diagonal").over(w).isNull()
    spans = lines.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(w))
    spans = spans.groupBy(*key, "span").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.bit_or("bits").alias("bits"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + (k - 1))))))
    spans = spans.withColumn("share", covered / F.col("size"))
    found = spans.groupBy("uid").agg(F.max("share").alias("share"), F.collect_set(F.when((F.col("share") >= cover) & (F.col("bits") == F.col("every")), F.col("label"))).alias("found"))
    rows = seen.where("gram is null").join(found, "uid", "left")
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    labels = F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), score.alias("score"))
