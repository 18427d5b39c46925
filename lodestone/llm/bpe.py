"""Byte-level BPE ids for whole Arrow columns, equal to those of the ``tokenizers`` library.

Texts are split into the tokenizer's pre-tokens with array operations over code points; a
pre-token's ids do not depend on its neighbours, so each distinct one goes through the
tokenizer once per process and all others are looked up by hash. The classes of code points
(letter, number, space, other) are asked of the tokenizer's own pre-tokenizer, hence no
second table of Unicode properties can disagree with it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textkit import _pow, mix, utf8

L, N, S, O = 1, 2, 3, 4  # noqa: E741
#: Distinct pre-tokens held by a process; beyond, the table starts anew.
CACHE = 250_000
CHARS = 1 << 19
_SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")
_loaded: dict[str, FastBpe] = {}


def fast_bpe(path: str) -> FastBpe:
    if path not in _loaded:
        _loaded[path] = FastBpe(path)
    return _loaded[path]


def _ranked(path: str):
    """A quicker encoder of one pre-token, where the file's merges stand in the order of
    their ids (then rank and id are the same thing, and results are too); else None."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model.get("vocab", {}), [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    order = [vocab.get(a + b, -1) for a, b in merges]
    if not order or order != sorted(order) or model.get("byte_fallback") or model.get("end_of_word_suffix"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    try:
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if len(token) == 1 or i >= order[0] and i <= order[-1]}
    except KeyError:
        return None
    if len(ranks) < 256 + len(order):
        return None
    return tiktoken.Encoding("ranked", pat_str=r"(?s:.)", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


class FastBpe:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.classes = np.zeros(0x110000, np.uint8)
        self.single = _ranked(path)
        self.tokenizer = None if self.single else tokenizer  # workers live on: one copy of the vocabulary
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int64)
        self.starts, self.lens, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _classify(self, code: int) -> int:
        c, split = chr(code), self.split
        one = lambda a: len(split(a + c)) == 1
        return L if one("a") else N if one("1") else O if one("!") else S

    def _class_of(self, codes: np.ndarray) -> np.ndarray:
        got = self.classes[codes]
        if not got.all():
            for code in np.unique(codes[got == 0]).tolist():
                self.classes[code] = self._classify(code)
            got = self.classes[codes]
        return got

    def _starts(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pre-tokens start; begins: where texts start (a sentinel follows the last)."""
        n = len(codes)
        kind = self._class_of(codes)
        edge = np.zeros(n + 1, bool)
        edge[begins] = True
        edge[n] = True
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        change |= edge[:n]
        space = kind == S
        run_end = space & np.append(change[1:] | edge[1:n], True)  # the last space of a run
        run_end &= ~edge[1:]  # at the end of a text a run stays whole
        start = change.copy()
        start |= run_end
        joins = run_end & (codes == 32)  # a blank goes with what follows
        start[1:] &= ~joins[:-1]
        start |= edge[:n]
        for p in np.flatnonzero((codes == 39) & start).tolist():
            for suffix in _SUFFIXES:
                q = p + 1 + len(suffix)
                if q <= n and not edge[p + 1 : q].any() and all(codes[p + 1 + i] == ord(x) for i, x in enumerate(suffix)):
                    start[p + 1 : q] = False
                    if q < n and kind[q] == L:
                        start[q] = True
                    break
        return np.flatnonzero(start)

    def _learn(self, fresh: np.ndarray, texts: list[str]) -> None:
        if len(self.keys) + len(fresh) > CACHE:
            self._forget()
        if self.single:
            ids = [np.asarray(self.single(t), np.uint32) for t in texts]
        else:
            ids = [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.array([len(x) for x in ids], np.int64)
        first = len(self.lens)
        self.starts = np.append(self.starts, len(self.pool) + np.cumsum(lens) - lens)
        self.lens = np.append(self.lens, lens)
        self.pool = np.concatenate([self.pool, *ids])
        keys, slots = np.append(self.keys, fresh), np.append(self.slots, np.arange(first, first + len(fresh)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.slots = keys[order], slots[order]

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return at

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        if lead[-1] != len(codes):  # not UTF-8: go text by text
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            at = np.cumsum([0, *map(len, texts)])
            codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        else:
            at = lead[offsets]
        n = len(codes)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        start = self._starts(codes, at[:-1][at[:-1] < n])
        end = np.append(start[1:], n)
        up, down = _pow(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        known = self.keys[self._find(u)] == u if len(self.keys) else np.zeros(len(u), bool)
        if not known.all():
            if len(self.keys) + len(u) > CACHE:
                self._forget()
                known[:] = False
            new = np.flatnonzero(~known)
            cut = lambda i: codes[start[i] : end[i]].tobytes().decode("utf-32-le", "surrogatepass")
            self._learn(u[new], [cut(i) for i in first[new].tolist()])
        slot = self.slots[self._find(u)][back]
        lens = self.lens[slot]
        upto = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=upto[1:])
        ids = self.pool[np.repeat(self.starts[slot] - upto[:-1], lens) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(start, at)]

    def _cut(self, data: np.ndarray, at: int) -> int:
        """A place of a text, at or after a byte, that pre-tokens never reach across: before
        white space after anything else, or before a mark after a letter or number."""
        while at < len(data):
            part = data[at : at + CHARS]
            lead = np.flatnonzero((part & 0xC0) != 0x80)  # code points that begin here
            if len(lead) < 3:
                break
            stop = len(part) if at + len(part) == len(data) else int(lead[-1])
            lead = lead[lead < stop]
            kind = self._class_of(np.frombuffer(part[lead[0] : stop].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32))
            if len(kind) != len(lead):  # not UTF-8
                break
            a, b = kind[:-1], kind[1:]
            fine = np.flatnonzero((a != S) & (b == S) | (b == O) & ((a == L) | (a == N)))
            if len(fine):
                return at + int(lead[fine[0] + 1])
            at += int(lead[-1])
        return len(data)

    def _long(self, data: np.ndarray) -> np.ndarray:
        """The ids of one text, by pieces of about CHARS bytes."""
        ids, at = [], 0
        while at < len(data):
            to = self._cut(data, at + CHARS)
            ids.append(self._block(data[at:to], np.array([0, to - at], np.int64))[0])
            at = to
        return np.concatenate(ids)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, in order; a null has none."""
        data, offsets = utf8(column)
        i, n = 0, len(offsets) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHARS, "right")) - 1)
            if offsets[j] - offsets[i] > 2 * CHARS:
                yield self._long(data[offsets[i] : offsets[j]])
                i = j
                continue
            ids, at = self._block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for k in range(j - i):
                yield ids[at[k] : at[k + 1]]
            i = j
