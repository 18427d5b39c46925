"""Vectorised words, word hashes and shingles over the UTF-8 buffers of Arrow columns.

Words are runs of bytes that a table calls word bytes. A word's hash is a polynomial over
its bytes modulo 2**64, read off one running sum for a whole block and then mixed, so no
Python object is made per word. Blocks hold about ``BLOCK`` bytes and end between words;
a longer text is cut between words, so memory follows the block and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
U = np.uint64
_BASE = 0x9E6C63D0876A9A47 | 1
_STEP = 0xD6E8FEB86659FD93 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _word_table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: Words of everything but white space (0x20, 0x09-0x0D).
SPACED = _word_table(lambda b: not (b == 0x20 or 9 <= b <= 13))
#: Words of digits, a-z and all beyond ASCII, after A-Z were lower-cased.
ALNUM = _word_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80)

_fold = np.arange(256, dtype=np.uint8)
_fold[0x41:0x5B] += 32
FOLD = _fold
_VALUE_RAW = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))
_VALUE_FOLD = _VALUE_RAW[_fold]
_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK) + 1
        inv = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, dtype=U), np.full(size, inv, dtype=U)
            up[0] = down[0] = 1
            _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(batch: pa.RecordBatch, column: str = "text", rows: int = 2000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most ``rows`` rows and, but for a single long row,
    ``size`` bytes of one column, so that memory does not follow the batch."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(upto, before + size, "right"))))
        yield batch.slice(at, to - at)
        at = to


def _pieces(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about BLOCK bytes that end at a text's end or between words."""
    at, end, i = 0, int(offsets[-1]), 0
    while at < end:
        to = min(at + BLOCK, end)
        if to < end:
            i = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[i] > at:
                to = int(offsets[i])
            else:  # one text longer than a block
                stop = int(offsets[i + 1])
                while to < stop:
                    gap = np.flatnonzero(~table[data[to : min(to + BLOCK, stop)]])
                    if len(gap):
                        to += int(gap[0])
                        break
                    to = min(to + BLOCK, stop)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each word, and each text's first word (n + 1 entries)."""
    value = _VALUE_FOLD if fold else _VALUE_RAW
    starts_all, ends_all, hashes = [], [], []
    for lo, hi in _pieces(data, offsets, table):
        block = data[lo:hi]
        inside = table[block]
        edge = np.zeros(hi - lo + 1, dtype=bool)
        inner = offsets[np.searchsorted(offsets, lo, "left") : np.searchsorted(offsets, hi, "right")] - lo
        edge[inner] = True
        edge[0] = edge[-1] = True
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        first = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        last = np.flatnonzero(inside & (~after | edge[1:])) + 1
        if not len(first):
            continue
        up, down = _pow(hi - lo)
        total = np.zeros(hi - lo + 1, dtype=U)
        np.cumsum(value[block] * up[: hi - lo], out=total[1:])
        hashes.append(mix((total[last] - total[first]) * down[first]))
        starts_all.append(first + lo)
        ends_all.append(last + lo)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, np.zeros(len(offsets), np.int64)
    start, end = np.concatenate(starts_all), np.concatenate(ends_all)
    return np.concatenate(hashes), start, end, np.searchsorted(start, offsets)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one sequence, in order (none if it is shorter)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, c = h[:n].copy(), 1
    for j in range(1, k):
        c = c * _STEP % (1 << 64)
        out += h[j : n + j] * U(c)
    return mix(out + U(k))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingles of one text, sorted; with fewer words the whole as one."""
    if not len(h):
        return np.zeros(0, U)
    return np.unique(grams(h, min(k, len(h))))


def unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
