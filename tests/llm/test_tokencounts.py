"""op8: totals by the library's counts; commits that repeat, overlap and fail."""

from collections import defaultdict

import pytest

from lodestone.llm import tokencounts as tc
from lodestone.llm.common import scratch_path
from lodestone.llm.queries import op8_token_counts, tokenizer_path
from tests.conftest import DATA
from tests.llm.test_packing import library

KIND = "doc_id long, source string, lang string, tokenizer string, tokens long, chars long"


def totals(rollup, *batches):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in rollup.totals(*batches).collect()}


def test_whole_table(spark):
    encode, want = library(), defaultdict(lambda: (0, 0, 0))
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        n, t, c = want[r.source, r.lang, "byte_bpe_50k"]
        want[r.source, r.lang, "byte_bpe_50k"] = (n + 1, t + len(encode(r.text)), c + len(r.text or ""))
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars) for r in op8_token_counts(spark, DATA).collect()}
    assert got == dict(want)


def test_signed_batches(spark):
    old = spark.createDataFrame([(1, "a", "en", "v1", 10, 40), (2, "a", "en", "v1", 5, 20), (3, None, None, "v1", 7, 9)], KIND)
    new = spark.createDataFrame([(1, "a", "en", "v2", 12, 40)], KIND)
    rollup = tc.TokenRollup(spark, scratch_path(spark, "rollup"))
    assert rollup.commit("load", tc.inserts(old)) and not rollup.commit("load", tc.inserts(old))
    assert totals(rollup, "load") == {("a", "en", "v1"): (2, 15, 60), (None, None, "v1"): (1, 7, 9)}
    assert rollup.commit("revise", tc.revisions(old.where("doc_id = 1"), new))
    assert rollup.commit("drop", tc.deletes(old.where("doc_id = 3")))
    for order in (("load", "revise", "drop"), ("drop", "load", "revise")):
        assert totals(rollup, *order) == {("a", "en", "v1"): (1, 5, 20), ("a", "en", "v2"): (1, 12, 40)}
    assert totals(rollup, "load", "unknown", "load") == totals(rollup, "load")
    assert totals(rollup) == totals(rollup, "load", "revise", "drop") and rollup.batches() == ["drop", "load", "revise"]
    with pytest.raises(ValueError):
        rollup.commit("../x", tc.inserts(old))


def test_a_failed_batch_is_written_anew(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, "a", "en", "v", 1, 1) for i in range(8)], KIND)
    rollup = tc.TokenRollup(spark, scratch_path(spark, "rollup"))
    broken = tc.inserts(rows).withColumn("tokens", F.when(F.col("doc_id") == 5, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("tokens")))
    with pytest.raises(Exception, match="lost"):
        rollup.commit("b", broken)
    assert totals(rollup, "b") == {} and rollup.commit("b", tc.inserts(rows))
    assert totals(rollup, "b") == {("a", "en", "v"): (8, 8, 8)}


def test_compaction_keeps_totals_and_names(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], "en", "v", 3, 1) for i in range(8)], KIND)
    rollup = tc.TokenRollup(spark, scratch_path(spark, "rollup"))
    assert totals(rollup) == {} and rollup.batches() == []
    for n in range(3):
        assert rollup.commit(f"b{n}", tc.inserts(rows))
    want = {("a", "en", "v"): (12, 36, 12), ("b", "en", "v"): (12, 36, 12)}
    assert totals(rollup) == want and rollup.compact() and totals(rollup) == want
    assert not rollup.commit("b1", tc.inserts(rows)) and rollup.commit("b3", tc.deletes(rows.where("source = 'a'")))
    want["a", "en", "v"] = (8, 24, 8)
    assert totals(rollup) == want and rollup.compact() and totals(rollup) == want
    assert totals(rollup, "b0") == {("a", "en", "v"): (4, 12, 4), ("b", "en", "v"): (4, 12, 4)}


def test_two_writers_of_one_batch(spark):
    """The second to finish does not count, though both began before either was committed."""
    rows = spark.createDataFrame([(1, "a", "en", "v", 3, 1)], KIND)
    one, two = (tc.TokenRollup(spark, path) for path in [scratch_path(spark, "rollup")] * 2)
    done = []
    write = one._write
    one._write = lambda df: (done.append(two.commit("b", tc.inserts(rows))), write(df))[1]
    assert not one.commit("b", tc.inserts(rows)) and done == [True]
    assert totals(one) == {("a", "en", "v"): (1, 3, 1)}
    fs, at = one._at("marks", "c")
    fs.create(at, False).close()  # a writer lost between creating and filling its marker
    assert not one.committed("c") and totals(one) == {("a", "en", "v"): (1, 3, 1)}
    assert two.commit("c", tc.inserts(rows)) and totals(one) == {("a", "en", "v"): (2, 6, 2)}


def test_odd_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, None, None, None, "x"), (1, "", "s", "en", "y"), (1, "a b", "s", "en", "z")], "doc_id long, text string, source string, lang string, tokens string")
    rows = tc.count_tokens(df, tokenizer_path(), "v").collect()
    assert sorted((r.source or "", r.tokens, r.chars) for r in rows) == [("", 0, 0), ("s", 0, 0), ("s", 2, 3)]
    rollup = tc.TokenRollup(spark, scratch_path(spark, "rollup"))
    assert rollup.commit("none", tc.inserts(tc.count_tokens(df.limit(0), tokenizer_path(), "v"))) and totals(rollup, "none") == {}
