"""Benchmark decontamination: item-sized windows, compared exactly.

For each benchmark item of w words all windows of w words of every text are judged by the
weighted Jaccard similarity of the shingle multisets, sum of minima over sum of maxima. A
window that reaches the threshold cannot lack all of an item's rarest shingles, when these
are more than it may miss; they are the item's anchors, and only windows that hold one are
looked at. In these all shared shingles are found, windows with too few are left out, and
the sums of minima of the others come from one sorted pass. No step can drop a match, and a
shingle that very many items or texts hold is no anchor where an item has rarer ones.

No SimHash decides: a repeated shingle moves many bits of a fingerprint of counts, so
windows above the threshold lie beyond any radius that is worth an index.

The benchmark goes to the executors in blocks of at most ``ITEM_BYTES`` of text, each one a
pass over the documents; nothing of the documents is shuffled or collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

K, SIMILARITY = 5, 0.8
ITEM_BYTES = 8 << 20
#: Hits and positions that are looked at together, so that memory follows neither the items
#: that share a shingle nor the texts of a batch.
TOGETHER = 1 << 20


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... of each range of n[i], one after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _groups(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of entries whose sizes add up to at most TOGETHER, or single larger ones."""
    upto, at = np.cumsum(size), 0
    while at < len(size):
        before = int(upto[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + TOGETHER, "right")))
        yield at, to
        at = to


def _own(gram: np.ndarray, item: np.ndarray) -> np.ndarray:
    """One key for a gram of an item."""
    return tk.mix(gram ^ tk.mix(item.astype(np.uint64) + np.uint64(1)))


class _Side:
    """The items whose shingles have one length: anchors by gram, and all their grams."""

    def __init__(self, parts: list[tuple[int, np.ndarray]], length: int, similarity: float) -> None:
        self.length = length
        total = {i: len(g) for i, g in parts}
        grams, items = np.concatenate([g for _, g in parts]), np.concatenate([np.full(len(g), i, np.int64) for i, g in parts])
        order = np.lexsort((items, grams))
        grams, items = grams[order], items[order]
        first = np.flatnonzero(np.append(True, (grams[1:] != grams[:-1]) | (items[1:] != items[:-1])))
        counts = np.diff(np.append(first, len(grams)))
        grams, items = grams[first], items[first]
        _, kind, holders = np.unique(grams, return_inverse=True, return_counts=True)
        order = np.lexsort((grams, holders[kind], items))  # of each item the rarest grams first
        c, i = counts[order], items[order]
        upto = np.cumsum(c)
        head = np.append(True, i[1:] != i[:-1])
        before = upto - c - np.maximum.accumulate(np.where(head, upto - c, 0))
        size = np.array([total[x] for x in i.tolist()])
        anchors = order[before < size - np.ceil(similarity * size - 1e-9) + 1]
        anchors = anchors[np.lexsort((items[anchors], grams[anchors]))]
        self.keys, self.who = grams[anchors], items[anchors]
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        own = _own(grams, items)
        order = np.argsort(own, kind="stable")
        self.own, self.counts = own[order], counts[order]

    def anchor_hits(self, g: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, item, position), sorted, of all hits; those of an item in a text together."""
        pos = np.flatnonzero(self.table[(g >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, g[pos], "left"), np.searchsorted(self.keys, g[pos], "right")
        row = np.searchsorted(at, pos, "right") - 1
        fine = (hi > lo) & (pos + self.length <= at[row + 1])
        pos, lo, row, n = pos[fine], lo[fine], row[fine], (hi - lo)[fine]
        if not len(pos):
            return
        ends = np.append(np.flatnonzero(np.diff(row)) + 1, len(pos))
        begins = np.append(0, ends[:-1])
        for a, b in _groups(np.add.reduceat(n, begins)):
            a, b = int(begins[a]), int(ends[b - 1])
            shares = -(-int(n[a:b].sum()) // TOGETHER)  # more than one for a single text only
            for share in range(shares):
                found = []
                for x, y in _groups(n[a:b]):
                    x, y = a + x, a + y
                    item = self.who[_ranges(lo[x:y], n[x:y])]
                    mine = item % shares == share
                    found.append((np.repeat(row[x:y], n[x:y])[mine], item[mine], np.repeat(pos[x:y], n[x:y])[mine]))
                r, i, p = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((p, i, r))
                if len(order):
                    yield r[order], i[order], p[order]


class Benchmark:
    """A block of items: their shingles by hash."""

    def __init__(self, rows: list[tuple[int, str]], k: int, similarity: float) -> None:
        self.similarity = similarity
        self.ids, sizes, totals = [], [], []
        h, _, _, at = tk.words(*tk.utf8(pa.array([t or "" for _, t in rows], pa.large_string())), tk.ALNUM)
        own: dict[int, list] = {}
        for r, (item, _) in enumerate(rows):
            words = h[at[r] : at[r + 1]]
            if item is None or not len(words):
                continue
            g = tk.grams(words, min(k, len(words)))
            own.setdefault(min(k, len(words)), []).append((len(self.ids), g))
            self.ids.append(item)
            sizes.append(len(words))
            totals.append(len(g))
        self.sizes, self.totals = np.array(sizes, np.int64), np.array(totals, np.int64)
        self.sides = [_Side(parts, length, similarity) for length, parts in own.items()]

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, float, int]]:
        """(row, item number, best similarity, first word) of each item found in a text."""
        h, _, _, at = tk.words(*tk.utf8(column), tk.ALNUM)
        if not len(h):
            return
        for side in self.sides:
            g = tk.grams(h, side.length)
            for row, item, pos in side.anchor_hits(g, at):
                yield from self._verified(side, g, at, row, item, pos)

    def _verified(self, side: _Side, g: np.ndarray, at: np.ndarray, row: np.ndarray, item: np.ndarray, pos: np.ndarray) -> Iterator[tuple[int, int, float, int]]:
        lo, w = at[row], self.sizes[item]
        run = np.minimum(w, at[row + 1] - lo) - side.length + 1  # shingles of a window; a shorter text is one
        last = at[row + 1] - side.length + 1 - run
        head = np.append(True, (np.diff(row) != 0) | (np.diff(item) != 0))
        # windows that hold an anchor, each once, and the shingles in them, each once
        begin, end = np.maximum(pos - run + 1, lo), np.minimum(pos, last)
        begin[1:] = np.where(head[1:], begin[1:], np.maximum(begin[1:], pos[:-1] + 1))
        windows = np.maximum(end - begin + 1, 0)
        reach = end + run
        start = begin.copy()
        start[1:] = np.where(head[1:], start[1:], np.maximum(start[1:], reach[:-1]))
        inside = np.maximum(reach - start, 0)
        heads = np.flatnonzero(head)
        tails = np.append(heads[1:], len(pos))
        for a, b in _groups(np.add.reduceat(inside, heads)):
            x, y = int(heads[a]), int(tails[b - 1])
            p = _ranges(start[x:y], inside[x:y])
            pair = np.repeat(np.cumsum(head[x:y]) - 1, inside[x:y])
            key = _own(g[p], item[heads[a:b]][pair])
            j = np.searchsorted(side.own, key)
            j[j == len(side.own)] = 0
            hit = side.own[j] == key
            p, pair, j = p[hit], pair[hit], j[hit]
            cut = np.searchsorted(pair, np.arange(b - a + 1))
            for q in np.flatnonzero(np.diff(cut) >= self._need(item[heads[a:b]], run[heads[a:b]])).tolist():
                z = int(heads[a + q])
                s, e = int(cut[q]), int(cut[q + 1])
                starts = _ranges(begin[z : tails[a + q]], windows[z : tails[a + q]])
                best = self._best(int(item[z]), int(run[z]), p[s:e], j[s:e], side.counts[j[s:e]], starts)
                if best:
                    yield int(row[z]), int(item[z]), best[0], best[1] - int(lo[z])

    def _need(self, item: np.ndarray | int, run: np.ndarray | int) -> np.ndarray:
        """The least intersection that a window of so many shingles needs."""
        return self.similarity * (self.totals[item] + run) / (1 + self.similarity) - 1e-9

    def _best(self, i: int, run: int, hits: np.ndarray, kind: np.ndarray, most: np.ndarray, start: np.ndarray) -> tuple[float, int] | None:
        """The most similar of the windows at ``start``; the first of equal ones."""
        start = start[np.searchsorted(hits, start + run) - np.searchsorted(hits, start) >= self._need(i, run)]
        if not len(start):
            return None
        both = _shared(hits, kind, most, start, run)
        x = both / (run + int(self.totals[i]) - both)
        at = int(np.argmax(x))
        return (float(x[at]), int(start[at])) if x[at] >= self.similarity else None


def _shared(hits: np.ndarray, kind: np.ndarray, most: np.ndarray, start: np.ndarray, run: int) -> np.ndarray:
    """Sums of minima of an item's counts ``most`` and those of the windows at ``start``.

    A shingle that the item has c times counts in a window unless c equal ones stand before
    it there: a hit at p counts for starts after both p - run and its c-th predecessor.
    """
    order = np.argsort(kind, kind="stable")
    kinds, p, c = kind[order], hits[order], most[order]
    rank = np.arange(len(p)) - np.searchsorted(kinds, kinds)
    late = np.flatnonzero(rank >= c)
    after = p - run
    after[late] = np.maximum(after[late], p[late - c[late]])
    return np.searchsorted(np.sort(after), start) - np.searchsorted(hits, start)


def _blocks(benchmark: DataFrame, k: int, similarity: float) -> Iterator[Benchmark]:
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        if rows and size + len(r[1] or "") > ITEM_BYTES:
            yield Benchmark(rows, k, similarity)
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += len(r[1] or "")
    if rows:
        yield Benchmark(rows, k, similarity)


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = K, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, item_id, similarity, first_word)`` for each document and item found in it.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. An
    item of fewer than k words is one shingle; an item without words or id finds nothing; a
    text shorter than an item is compared as one window. Null and empty texts hold nothing.
    Each row is judged on its own, also with a null or repeated doc_id. Further columns are
    ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], "doc_id long, item_id long, similarity double, first_word long")
    for block in _blocks(benchmark, k, similarity):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in tk.parts(whole):
                    found = [(r, shared.value.ids[i], x, s) for r, i, x, s in shared.value.matches(b.column("text"))]
                    rows = pa.array([f[0] for f in found], pa.int64())
                    rest = [pa.array([f[j] for f in found], t) for j, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()))]
                    yield pa.record_batch([b.column("doc_id").take(rows), *rest], names=["doc_id", "item_id", "similarity", "first_word"])

        out = out.unionByName(docs.mapInArrow(run, "doc_id long, item_id long, similarity double, first_word long"))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; nothing is shuffled."""
    for block in _blocks(benchmark, k, similarity):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in tk.parts(whole):
                    keep = np.ones(b.num_rows, bool)
                    for r, *_ in shared.value.matches(b.column(b.schema.names.index("text"))):
                        keep[r] = False
                    yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
