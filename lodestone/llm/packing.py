"""Packing by multiway Karmarkar-Karp differencing.

A document's ids are cut into whole windows and a rest. Rests are packed in blocks: each
enters as a partial partition of m windows that holds it alone; the two partial partitions
of largest spread are merged, the fullest windows of one onto the emptiest of the other,
until one is left, whose windows are nearly equal. m starts at the least number that can
hold the block and rises while the fullest window exceeds the capacity. Rests enter in
pieces of at most ``piece`` ids: with about eight or more to a window the differences that
remain are a few ids, and padding stays near half a percent.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import fast_bpe

CAPACITY, BLOCK, PIECE = 2048, 1200, 256
_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def karmarkar_karp(sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows' sums and each item's window, by largest differencing into m windows.

    A partial partition keeps its non-empty windows only, in falling order of their sums;
    ties go to the earlier item, so the result is a function of the sizes.
    """
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heap = [(-int(s), i, [(int(s), i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    parent = list(range(n))  # windows as trees of items: an item is in its root's window

    def spread(windows: list[tuple[int, int]]) -> int:
        return windows[0][0] - (windows[-1][0] if len(windows) == m else 0)

    serial = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - m
        if over <= 0:
            c = sorted(a + b, key=lambda w: (-w[0], w[1]))
        else:  # the smallest of a take the largest of b's overlap, in opposite order
            kept, both = a[: len(a) - over], a[len(a) - over :]
            b_over, b_kept = b[len(b) - over :], b[: len(b) - over]
            merged = []
            for (x, i), (y, j) in zip(both, reversed(b_over), strict=True):
                parent[j] = i
                merged.append((x + y, i))
            c = sorted(kept + b_kept + merged, key=lambda w: (-w[0], w[1]))
        heapq.heappush(heap, (-spread(c), serial, c))
        serial += 1
    windows = heap[0][2]
    number = {root: k for k, (_, root) in enumerate(windows)}
    where = np.empty(n, np.int64)
    for i in range(n):
        r = i
        while parent[r] != r:
            r = parent[r]
        while parent[i] != r and parent[i] != i:
            parent[i], i = r, parent[i]
    for i in range(n):
        r = i
        while parent[r] != r:
            r = parent[r]
        where[i] = number[r]
    return np.array([s for s, _ in windows], np.int64), where


def pack_block(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Each item's window and the number of windows, none above the capacity."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        sums, where = karmarkar_karp(sizes, m)
        if sums.max(initial=0) <= capacity:
            return where, m
        m += max(1, -(-int(np.maximum(sums - capacity, 0).sum()) // capacity))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, block: int = BLOCK, piece: int = PIECE, end_id: int = 1) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` ids.

    A document's ids are those of its text and then ``end_id``; a null text is an empty one.
    Returns doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit
    numbers), doc_tokens, sequence_id and offset. Offsets of a sequence run from 0 without
    gaps. Every row is a document of its own, also where doc_id is null or repeated; further
    columns are ignored; an empty table gives no pieces.

    A task packs the documents it reads in blocks of ``block`` pieces: nothing is shuffled,
    no source or key can make a task large, and a lost task gives the same rows again. A
    sequence_id is the task's partition number times 2**33 plus a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, last = fast_bpe(tokenizer), np.array([end_id], np.uint32)
        base, count = TaskContext.get().partitionId() << 33, 0
        waiting: list[tuple] = []
        whole: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal count, waiting, whole
            out = whole
            whole = []
            if waiting:
                sizes = np.array([w[2] for w in waiting], np.int64)
                where, m = pack_block(sizes, capacity)
                fill = [0] * m
                for w, k in zip(waiting, where.tolist(), strict=True):
                    out.append((*w, base + count + k, fill[k]))
                    fill[k] += w[2]
                count += m
                waiting = []
            cols = list(zip(*out, strict=True)) or [[]] * 7
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in _OUT.split(", ")])

        for b in batches:
            for doc, ids in zip(b.column("doc_id").to_pylist(), bpe.encode(b.column("text")), strict=True):
                ids = np.concatenate([ids, last]).astype("<u4")
                total, at = len(ids), 0
                while total - at >= capacity:
                    whole.append((doc, at, capacity, zlib.crc32(ids[at : at + capacity].tobytes()), total, base + count, 0))
                    count += 1
                    at += capacity
                while at < total:
                    n = min(piece, total - at)
                    waiting.append((doc, at, n, zlib.crc32(ids[at : at + n].tobytes()), total))
                    at += n
                if len(waiting) >= block or len(whole) >= 4096:
                    yield flush()
        if waiting or whole:
            yield flush()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, _OUT)
