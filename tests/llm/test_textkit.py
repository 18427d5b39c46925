"""Words and shingles against regular expressions, with blocks smaller than the texts."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import textkit as tk

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
KINDS = {"spaced": (tk.SPACED, re.compile(rb"[^\x20\x09-\x0D]+")), "alnum": (tk.ALNUM, re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("block", [3, 8, 1 << 19])
@settings(max_examples=40, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.text(alphabet="abC 1.\té\n", max_size=40)), max_size=6))
def test_words_are_those_of_the_pattern(kind, block, texts):
    table, pattern = KINDS[kind]
    before, tk.BLOCK = tk.BLOCK, block
    try:
        data, offsets = tk.utf8(pa.array(texts, pa.string()))
        h, start, end, first = tk.words(data, offsets, table)
    finally:
        tk.BLOCK = before
    own = [pattern.findall((t or "").encode().translate(LOWER)) for t in texts]
    want, counts = [w for x in own for w in x], [len(x) for x in own]
    assert [data[a:b].tobytes().translate(LOWER) for a, b in zip(start, end, strict=True)] == want
    assert first.tolist() == np.cumsum([0, *counts]).tolist()
    by_word = dict(zip(want, h.tolist(), strict=True))
    assert [by_word[w] for w in want] == h.tolist() and len(set(by_word.values())) == len(by_word)


def test_very_long_text_equals_its_words():
    text = " ".join(f"Word{i % 997}" for i in range(300_000))  # several blocks
    h, _, _, first = tk.words(*tk.utf8(pa.array([text, "word1"])), tk.SPACED)
    assert first.tolist() == [0, 300_000, 300_001] and len(np.unique(h)) == 997 and h[1] == h[-1]
    assert len(tk.shingles(h[:-1], 5)) == 997


def test_shingles_of_short_texts():
    h = np.arange(1, 4, dtype=np.uint64)
    assert len(tk.shingles(h[:0], 5)) == 0 and len(tk.shingles(h, 5)) == 1 and len(tk.shingles(h, 3)) == 1
    assert tk.shingles(h, 5)[0] != tk.shingles(h[:2], 5)[0]


def test_slices_of_arrow_columns():
    column = pa.array(["a b", None, "c", "d e f"])
    for part in (column.slice(1, 2), column.cast(pa.large_string()).slice(2)):
        data, offsets = tk.utf8(part)
        assert data.tobytes().decode() == "".join(x or "" for x in part.to_pylist()) and len(offsets) == len(part) + 1


def test_batches_are_bounded_and_smaller_ones_stay(spark):
    from lodestone.llm.common import BATCH_BYTES, bound_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        for value, want in (("64m", f"{BATCH_BYTES}b"), ("1m", "1m"), (None, f"{BATCH_BYTES}b")):
            spark.conf.set(key, value) if value else spark.conf.unset(key)
            bound_batches(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.unset(key)
