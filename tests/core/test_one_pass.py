"""What the stored graph and the sparse lists make in one pass over a text is what the expressions make."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import extract, graph, retrieve, walk
from lodestone.plans import tables
from lodestone.plans.build import graph_tables, mentioned

SCHEMA = "chunk_id string, doc_id long, ord int, text string"
TEXTS = [
    "Alice met Robert in Paris. Alice left. nothing here",
    "no names at all. none",
    "",
    None,
    "Under Quebec is Alice | Robert and QUEBEC! alicex?  Paris . x",
    "Kelvin was Kelvin. İstanbul and Istanbul. i̇stanbul. Ärger Straße. ΣΣ Alice",
    "Robert Robert robert. . ! ? Aaliceb. Paris",
    "In Paris is Robert. " * 12,
]


def chunks(spark, again=False):
    rows = [(f"c{i}", i // 2, i % 2, t) for i, t in enumerate(TEXTS)] + [("lone", None, 0, "Alice from Madrid. Madrid was"), (None, 9, 0, "Nobody and Robert")]
    rows += [("c0", 7, 3, "Lisbon and Paris. Vienna")] if again else []  # an id that comes twice
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b):
    return sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))


def test_facts_in_one_pass(spark):
    found = extract.heuristic_facts(chunks(spark))
    want = extract.fact_entities(extract.facts(extract.heuristic_extraction(chunks(spark))))
    got = extract.bound_entities(found)
    assert same(got, want) and got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
    named = chunks(spark).withColumn("doc_id", F.col("doc_id").cast("string"))
    assert dict(extract.heuristic_facts(named).dtypes)["doc_id"] == "string"


@pytest.mark.parametrize("held", [extract.HELD, 1])
def test_first_mentions_make_the_same_entities(spark, monkeypatch, held):
    monkeypatch.setattr(extract, "HELD", held)
    monkeypatch.setattr(extract, "SLICE", 3)
    known = chunks(spark).repartition(3)
    want = graph.entity_nodes(mentioned(known).withColumn("chunk_text", F.substring("chunk_text", 1, 40)))
    assert same(graph.entity_nodes(extract.first_mentions(known, 40)), want)
    many = spark.createDataFrame([(f"c{i}", i, 0, "Alice in Paris") for i in range(1000)], SCHEMA).coalesce(1)
    if held > 1:
        assert extract.first_mentions(many, 40).count() == 2  # and not 2,000


@pytest.mark.parametrize("again", [False, True])
def test_the_stored_graph_is_that_of_the_expressions(spark, again):
    rows = chunks(spark, again)
    one, two = graph_tables(rows, tables.type_cache, keep=True), graph_tables(rows, tables.type_cache(graph.entity_nodes(mentioned(rows))))
    for name in ("bound", "texts", "links", "pairs", "typed", "nodes", "edges"):
        assert same(getattr(one, name), getattr(two, name)), name
    pairs = graph.asserted_together(extract.heuristic_facts(rows), one.texts)
    if again:
        assert pairs is None  # the two c0 share facts' ids: these are joined
    else:
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert same(pairs, one.pairs) and plan.count("Join") == 1  # no fact is joined with a fact


def test_texts_are_split_where_they_are_scored(spark):
    rows = [(1, "red Green blue"), (2, None), (3, "GREEN green x1"), (3, "green"), (None, "blue"), (4, "greK İx blue-red"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "green blue"), (2, "x1 i red"), (3, "grek"), (4, "none")], "qid long, text string")
    terms = retrieve.query_terms(asked, "qid", "text")
    want = retrieve.sparse_top(retrieve.document_terms(docs, "doc_id", "text"), terms, 3)
    texts = retrieve.document_texts(docs, "doc_id", "text")
    assert texts.columns == ["doc_id", "texts"] and same(retrieve.sparse_top(texts, terms, 3), want) and want.count() == 7


def test_bits_are_spread_before_they_become_rows(spark):
    bits = spark.range(1000).coalesce(1)
    assert walk.spread(bits).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
