"""op1: ids by the library, sums, gaps and padding."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe, packing
from lodestone.llm.bpe import fast_bpe
from lodestone.llm.queries import op1_packing, tokenizer_path
from tests.conftest import DATA

TEXTS = [None, "", " ", "a", "don't we'll I'VE 'quote", "  two  blanks \n\n\t tab", "Ünïcødé 汉字 😀‍👩 ١٢٣", "<|endoftext|> x", "1234567 a1b2", "x" * 5000, "é\u0301\u00a0nbsp\u3000wide "]


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def check(rows, docs, capacity=2048):
    """docs: (doc_id, text); every row a document of its own with a distinct id."""
    ids, encode = {}, library()
    for d, t in docs:
        ids[d] = encode(t) + [1]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        own = np.array(ids[r.doc_id], "<u4")[r.start : r.start + r.length]
        assert len(own) == r.length > 0 and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert pieces.keys() == ids.keys()
    for d, own in pieces.items():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and sum(r.length for r in own) == len(ids[d])
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1]) and sum(r.length for r in own) <= capacity
    return sequences


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    sequences = check(op1_packing(spark, DATA).collect(), docs)
    total = sum(r.length for own in sequences.values() for r in own)
    assert total / (2048 * len(sequences)) > 0.97


def test_odd_texts_and_columns(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, start int")
    check(packing.pack(df, tokenizer_path()).collect(), [(r[0], r[1]) for r in rows])


def test_null_and_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, None), (7, "c")], "doc_id long, text string")
    rows = packing.pack(df, tokenizer_path()).collect()
    assert sorted((r.doc_id is None, r.doc_tokens) for r in rows) == [(False, 1), (False, 2), (True, 3), (True, 3)]
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=12))
def test_ids_are_the_librarys(texts):
    encode = library()
    got = list(fast_bpe(tokenizer_path()).encode(pa.array(texts, pa.string())))
    assert [g.tolist() for g in got] == [encode(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sté汉。1 2\n\t,.!\u00a0\u3000😀"), max_size=120), max_size=4), st.sampled_from([1, 5, 17]))
def test_long_texts_in_pieces(texts, chars):
    encode, before = library(), bpe.CHARS
    bpe.CHARS = chars
    try:
        got = list(fast_bpe(tokenizer_path()).encode(pa.array(texts, pa.string())))
    finally:
        bpe.CHARS = before
    assert [g.tolist() for g in got] == [encode(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60), st.sampled_from([64, 100]))
def test_windows_hold_their_capacity(sizes, capacity):
    where, m = packing.pack_block(np.array(sizes), capacity)
    sums = np.bincount(where, weights=sizes, minlength=m)
    assert sums.max() <= capacity and len(where) == len(sizes) and where.max() < m


def test_differencing_balances():
    sums, where = packing.karmarkar_karp(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(sums) == [14, 16]  # the method's known result
    sizes = np.random.default_rng(1).integers(1, 256, 1200)
    sums, _ = packing.karmarkar_karp(sizes, 75)
    assert sums.max() - sums.min() <= 16 and sums.sum() == sizes.sum()


@pytest.mark.parametrize("n", [0, 1])
def test_few_items(n):
    where, m = packing.pack_block(np.full(n, 5), 10)
    assert len(where) == n and m == 1
