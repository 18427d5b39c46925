"""The pipeline's stages against the operators and brute force, one after the other."""

import pytest

import corpus_pipeline as cp
from tests.conftest import DATA
from tests.llm import test_decontam, test_neardup, test_packing


def test_stages_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in cp.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            after = {r.doc_id for r in out.collect()}
        if name == "minhash_near_dedup":
            assert after == {d for d, (_, _, kept) in test_neardup.brute(before, 80).items() if kept}
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert after == {d for d, _ in before} - {d for d, _ in test_decontam.brute(before, items)}
        if name == "packing":
            test_packing.check(out.collect(), before)
        else:
            assert 0 < len(after) <= len(before)
            docs = spark.createDataFrame(out.collect(), out.schema)


def test_run_is_the_stages_in_order(spark):
    docs = cp.read_table(spark, DATA, "documents")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, DATA)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    a, b = cp.run(spark, DATA).collect(), docs.collect()
    # where documents lie differs between runs, and with it how rests are cut
    total = lambda rows: {d: sum(r.length for r in rows if r.doc_id == d) for d in {key(r)[0] for r in rows}}
    assert total(a) == total(b)


KIND = "doc_id long, text string, lang string, source string, n_chars long, kept string, item_id long, quality string"


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None, None, None), (None, "a", "", "", 1, "", 1, ""), (1, "", "en", "s", 0, "x", 2, "y"), (1, "", "en", "s", 0, "x", 2, "y"), (2, "word " * 20000, None, None, None, None, None, None)]])
def test_odd_documents_pass_every_stage(spark, rows):
    docs = spark.createDataFrame(rows, KIND)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DATA)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r[0] for r in rows}
        else:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), KIND)
    if rows:
        assert docs.where("doc_id is null").count() == 2 and docs.where("doc_id = 1").count() == 1
