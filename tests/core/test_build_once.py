"""Facts are made only of chunks that can bind one; a fact is lowered once, its mentions are found once."""

from pyspark.sql import functions as F

from lodestone.operators import extract
from lodestone.plans.build import graph_tables

CHUNKS = [("c0", 1, 0, "Alice met Robert in Paris. Alice left. nothing here"), ("c1", 1, 1, "no names at all. none"), ("c2", 2, 0, "Under Quebec is Alice | Robert and Quebec. x")]


def test_chunks_without_entities_make_no_facts(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, doc_id long, ord int, text string")
    bound = graph_tables(chunks).bound
    want = extract.fact_entities(extract.facts(extract.heuristic_extraction(chunks)))
    assert sorted(map(repr, bound.collect())) == sorted(map(repr, want.collect())) and bound.count() == 9
    assert "(size(entities" in bound._jdf.queryExecution().analyzed().toString()


def test_a_fact_is_lowered_once_and_its_mentions_are_found_once(spark):
    found = extract.contained_entities(F.col("f"), F.array(F.lit("Robert"), F.lit("Carol"), F.lit("Alice")))
    rows = spark.createDataFrame([("Alice met ROBERT",), ("",), (None,)], "f string").select(found.alias("e"))
    assert [r.e for r in rows.collect()] == [["Robert", "Alice"], [], []]
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, doc_id long, ord int, text string")
    plan = extract.heuristic_extraction(chunks).select("facts")._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 2  # of the chunk and of the fact
