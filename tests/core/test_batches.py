"""Work on batches of questions that reach the same part of the graph is done once and not per question."""

import pytest
from pyspark.sql import functions as F

import lodestone.queries as core
from lodestone.operators import evidence, expand, prior, rank, walk
from tests.conftest import DATA

EDGES = "src string, dst string, edge_type string"


def test_hops_and_counts_hold_questions_as_bits(spark):
    asked = 300  # more than one block
    edges = [("p", f"e{i}", "ASSERTS") for i in range(50)] + [(f"e{i}", p, "INVOLVED_IN") for i in range(50) for p in ("p", f"q{i}")]
    edges = spark.createDataFrame(edges, EDGES)
    first = spark.createDataFrame([(q, "p") for q in range(asked)] + [(None, "p"), (7, "lone")], "qid long, id string")
    ents = walk.propositions_to_entities(first, edges)
    assert {(r.qid, r.id) for r in ents.collect()} == {(q, f"e{i}") for q in [*range(asked), None] for i in range(50)}
    assert walk.packed(ents, walk.places(ents.select("qid").distinct())).count() == 50 * 2  # and not 50 * 301
    reached = walk.entities_to_propositions(ents, edges, first)
    assert reached.count() == (asked + 1) * 51 + 1
    nodes = ents.unionByName(reached)
    got = {(r.qid, r.edge_type): r.n_edges for r in walk.induced_counts(nodes, edges).collect()}
    assert got == {(q, k): n for q in range(asked) for k, n in (("ASSERTS", 50), ("INVOLVED_IN", 100))}
    sizes = {r.qid: (r.n_seed_chunks, r.n_q_nodes, r.n_q_edges) for r in walk.subgraph_sizes(first.where("id = 'p'"), nodes, edges).collect()}
    assert sizes == {q: (1, 102 if q == 7 else 101, 150) for q in range(asked)}


def test_scores_of_many_questions(spark):
    texts = spark.createDataFrame([("a", "red green blue"), ("b", ""), ("c", "Green")], "id string, text string")
    queries = spark.createDataFrame([(q, "green" if q % 2 else "Blue green x") for q in range(300)] + [(300, " ")], "qid long, text string")
    props = spark.createDataFrame([(q, i) for q in range(302) for i in "abcz"], "qid long, id string")
    got = {(r.qid, r.id): r.s_sem for r in rank.semantic_scores(props, queries, texts).collect()}
    share = lambda q, i: 0.0 if q == 300 or i == "b" else 1.0 if q % 2 else round((2 if i == "a" else 1) / 3, 6)
    assert got == {(q, i): share(q, i) for q in range(301) for i in "abc"}
    known = spark.createDataFrame([(i, 0.25) for i in "abz"], "id string, s_struct double")
    one = rank.scored_propositions(props, queries, texts, known)
    two = rank.proposition_scores(props, rank.semantic_scores(props, queries, texts), known)
    assert sorted(map(repr, one.select(*two.columns).collect())) == sorted(map(repr, two.collect())) and one.count() == 302 * 3
    looked = {(r.qid, r.id) for r in rank.struct_scores(props, known).collect()}
    assert looked == {(q, i) for q in range(302) for i in "abz"}


@pytest.mark.parametrize("least", [0.1, -0.1])
def test_chunk_bests_follow_only_scores_that_can_win(spark, least):
    edges = [("p", "c"), ("r", "c"), ("p", "d"), ("s", "d"), ("u", "d"), ("r", "far"), ("p", "f"), ("none", "f")]
    edges = spark.createDataFrame([(*e, "SUPPORTED_BY") for e in edges], EDGES)
    props = spark.createDataFrame([(1, "p", least)], "qid long, id string, final double")
    scores = spark.createDataFrame([(1, "p", least), (1, "r", 0.9), (1, "s", least - 0.05), (1, "u", least), (2, "s", 1.0)], "qid long, id string, final double")
    got = {r.chunk: r.c_score for r in evidence.chunk_bests(props, scores, edges).collect()}
    assert got == {"c": 0.9, "d": least, "f": max(least, 0.0)}
    assert {r.chunk: (r.prop, r.c_score) for r in evidence.chunk_scores(props, scores, edges).collect()} == {c: ("p", x) for c, x in got.items()}


def test_grown_equals_the_decay_of_the_lineage(spark):
    rows = [(f"p{i}", f"e{i % 3}", "ASSERTS") for i in range(9)]
    edges = spark.createDataFrame(rows + [(e, p, "INVOLVED_IN") for p, e, _ in rows], EDGES)
    anchored = spark.createDataFrame([(1, "p0", 0.9), (1, "p1", 0.8), (2, "p3", 0.7)], "qid long, id string, final double")
    kept = spark.createDataFrame([(1, "e0"), (1, "e1"), (2, "e0")], "qid long, id string")
    known = spark.createDataFrame([("p4", 0.5)], "id string, s_struct double")
    scored = spark.createDataFrame([(1, "p6", 0.6)], "qid long, id string, final double")
    more = expand.without_anchors(expand.expanded(expand.candidates(anchored, edges), kept, edges), anchored)
    want = {tuple(r) for r in expand.decayed(more, anchored, known, scored).collect()}
    assert {tuple(r) for r in expand.grown(anchored, kept, edges, known, scored).collect()} == want and len(want) == 6


def test_a_query_builds_only_what_it_reads(spark):
    core._built.clear()
    core.queries()["hop_e_to_p"](spark, DATA).select(F.count("*")).collect()
    assert {name for (_, _, name) in core._built} == {"tables", "graph", "sparse", "path"}
    assert set(core._path(spark, DATA)) == {"seeds", "first", "ents"}


def test_the_skeleton_needs_neither_types_nor_nodes(spark):
    core._built.clear()
    assert core.queries()["ep_skeleton"](spark, DATA).count() > 0
    assert {name for (_, _, name) in core._built} == {"tables"}
    assert "typed" not in core._tables(spark, DATA).__dict__


def test_rounds_of_core_numbers_broadcast_no_values(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], "u string, v string")
    fresh = prior._fresh_values(edges, prior.degrees(edges).withColumnRenamed("degree", "core"))
    assert {(r.id, r.old, r.core) for r in fresh.collect()} == {("a", 1, 1), ("b", 2, 1), ("c", 1, 1)}
    assert "Broadcast" not in fresh._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cells", [evidence.CELLS, 40])
def test_leading_chunks_are_those_of_all_scores(spark, monkeypatch, cells):
    """Three chunks per proposition as from all chunk scores, but without a row per question and chunk."""
    monkeypatch.setattr(evidence, "CELLS", cells)  # 40: several blocks of questions
    edges = [(f"p{p}", f"c{c:04d}", "SUPPORTED_BY") for c in range(3000) for p in range(12) if (c * 7 + p * p) % (p + 2) == 0]
    edges = spark.createDataFrame(edges, EDGES)
    final = lambda q, p: round(((q * 5 + p * 3) % 7) / 10, 9)  # many ties
    scores = [(q, f"p{p}", final(q, p)) for q in range(9) for p in range(12) if (q + p) % 5]
    scores = spark.createDataFrame([*scores, *scores[:20]], "qid long, id string, final double")
    props = spark.createDataFrame([(q, f"p{p}", final(q, p)) for q in range(9) for p in range(q, q + 4) if p < 12], "qid long, id string, final double")
    want = evidence.chunks_per_proposition(evidence.chunk_scores(props, scores, edges))
    led = evidence.leading_chunks(props, scores, edges)
    assert sorted(evidence.chunks_per_proposition(led).select(*want.columns).collect()) == sorted(want.collect())
    assert led.count() <= props.count() * 3 * led.rdd.getNumPartitions() < evidence.chunk_scores(props, scores, edges).count()


def test_only_cited_texts_are_moved_to_the_buckets(spark):
    nodes = [("p", "proposition", "P"), ("c", "chunk", "C"), ("e", "entity", "E"), ("type::X", "type", "X"), ("e", "type", "no entity")]
    nodes = spark.createDataFrame([*nodes, *((f"x{i}", "chunk", "never cited") for i in range(500))], "id string, node_type string, text string")
    edges = spark.createDataFrame([("p", "e", "ASSERTS"), ("e", "type::X", "IS_A")], EDGES)
    props = spark.createDataFrame([(1, "p", 0.5)], "qid long, id string, final double")
    kept = spark.createDataFrame([(1, "p", "c", 0.5, 0.5), (1, "p", "gone", 0.5, 0.5)], "qid long, prop string, chunk string, p_final double, c_score double")
    found = evidence.buckets(props, kept, edges, nodes)
    assert {(r.node_type, r.id, r.text, r.score) for r in found.collect()} == {("proposition", "p", "P", 0.5), ("chunk", "c", "C", 0.5), ("entity", "e", "E", 0.5), ("type", "type::X", "X", 0.5)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2
