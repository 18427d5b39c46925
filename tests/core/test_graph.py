import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evidence, expand, extract, graph, intent, prior, rank, retrieve, walk
from lodestone.plans.answer import Engine, build_index
from lodestone.plans.build import full_prior, graph_tables

CHUNKS = "chunk_id string, doc_id long, ord long, text string"


def small(spark):
    rows = [
        ("c0", 1, 0, "Alice Walker met Robert in Paris. Robert lives near Paris!"),
        ("c1", 1, 1, "Berlin is large. alice walker was never in Berlin."),
        ("c2", 2, 0, "Berlin is large."),
        ("c3", 2, 1, "nothing named here"),
    ]
    return spark.createDataFrame(rows, CHUNKS)


def test_facts_bind_entities_case_aside(spark):
    ex = extract.heuristic_extraction(small(spark))
    got = {r.fact_id: set(r.entities) for r in extract.facts(ex).collect()}
    assert got["c1_fact_1"] == {"Berlin"} and got["c0_fact_0"] == {"Alice", "Walker", "Robert", "Paris"}
    assert [r.fact_id for r in extract.unbound_facts(extract.facts(ex)).collect()] == ["c3_fact_0"]
    assert {tuple(r) for r in extract.extraction_violations(ex).collect()} == {("c3", "no_entities")}


def test_propositions_take_ten_texts_and_merge(spark):
    rows = [("c", 1, i, f"Berlin fact number {i:02d}.") for i in range(14)] + [("d", 2, 0, "Alpha Gamma."), ("e", 3, 0, "Alpha Gamma.")]
    rows = [(f"{c}{o}", d, o, t) for c, d, o, t in rows]
    t = graph_tables(spark.createDataFrame(rows, CHUNKS))
    texts = {r.entity: (r.prop_id, r.prop_text) for r in t.texts.collect()}
    assert texts["Berlin"][1].count("Berlin") == 10 and "number 09" in texts["Berlin"][1] and "number 10" not in texts["Berlin"][1]
    assert texts["Alpha"] == texts["Gamma"]
    props = {r.prop_id: r for r in graph.proposition_rows(t.texts, t.links, t.pairs).collect()}
    assert len(props[texts["Berlin"][0]].fact_ids) == 14
    assert props[texts["Alpha"][0]].entity_ids == ["Alpha", "Gamma"] and props[texts["Alpha"][0]].chunk_ids == ["d0", "e0"]


def test_graph_has_no_dangling_edge_and_one_node_per_surface(spark):
    cache = spark.createDataFrame([("berlin", "LOCATION"), ("paris", "PLANET")], "canonical string, label string")
    g = graph_tables(small(spark), cache, keep=True).stored()
    assert graph.dangling(g.edges, g.nodes).count() == 0
    assert g.nodes.count() == g.nodes.select("id").distinct().count()
    types = {r.src: r.dst for r in g.of("IS_A").collect()}
    assert types["ent::berlin"] == "type::LOCATION" and types["ent::paris"] in ("type::LOCATION", "type::PERSON", "type::OTHER")
    a, b = g.of("ASSERTS"), g.of("INVOLVED_IN")
    assert {(r.src, r.dst) for r in a.collect()} == {(r.dst, r.src) for r in b.collect()}


def brandes(adj):
    out = dict.fromkeys(adj, 0.0)
    for s in adj:
        dist, sigma, order, before = {s: 0}, defaultdict(float, {s: 1.0}), [], defaultdict(list)
        q = deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                out[w] += delta[w]
    n = len(adj)
    return {v: x / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in out.items()}


def peeled(adj):
    adj, core, k = {v: set(n) for v, n in adj.items()}, {}, 0
    while adj:
        v = min(adj, key=lambda x: len(adj[x]))
        k = max(k, len(adj[v]))
        core[v] = k
        for w in adj.pop(v):
            adj[w].discard(v)
    return core


@pytest.mark.parametrize("seed,n,m", [(1, 14, 24), (2, 10, 9), (3, 2, 1)])
def test_prior_against_sequential_algorithms(spark, seed, n, m):
    rnd, adj = random.Random(seed), defaultdict(set)
    while sum(map(len, adj.values())) < 2 * m:
        u, v = rnd.sample([f"n{i}" for i in range(n)], 2)
        adj[u].add(v), adj[v].add(u)
    skel = spark.createDataFrame([(u, v) for u, near in adj.items() for v in near], "u string, v string")
    assert {r.id: r.core for r in prior.core_numbers(skel).collect()} == peeled(adj)
    want = brandes(adj)
    for bound in (1000, 0):  # by broadcast, and by joins
        got = {r.id: r.betweenness for r in prior.betweenness(skel, bound).collect()}
        assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    scores = [r.s_struct for r in prior.structural_prior(skel).collect()]
    assert all(0 <= s <= 1 for s in scores)


def test_betweenness_from_drawn_sources(spark):
    rnd, adj = random.Random(4), defaultdict(set)
    for _ in range(160):
        u, v = rnd.sample([f"n{i}" for i in range(60)], 2)
        adj[u].add(v), adj[v].add(u)
    skel = spark.createDataFrame([(u, v) for u, near in adj.items() for v in near], "u string, v string")
    want = brandes(adj)
    got = lambda *a: {r.id: r.betweenness for r in prior.betweenness(skel, *a).collect()}
    assert all(abs(x - want[v]) < 1e-9 for v, x in got(1000, len(adj)).items())
    local, joined = got(1000, 30), got(0, 30)
    assert local.keys() == joined.keys() == want.keys() and all(abs(x - joined[v]) < 1e-9 for v, x in local.items())
    assert abs(sum(local.values()) / sum(want.values()) - 1) < 0.2 and local != want


def test_constant_values_scale_to_zero(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "id string, v double")
    assert {r.x for r in prior.scaled(df, "v", "x").collect()} == {0.0}


def test_rankings_break_ties_by_id_and_keep_scores(spark):
    scored = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.9)], "qid long, id string, final double")
    assert [r.id for r in rank.best(scored, 2).orderBy("rk").collect()] == ["c", "a"]
    p = spark.createDataFrame([("x", 0.5), ("c", 0.1)], "id string, s_struct double")
    lineage = spark.createDataFrame([(1, "x", "c", "e"), (1, "x", "a", "e"), (1, "b", "a", "e")], "qid long, prop string, anchor string, entity string")
    anchors = scored.where("id in ('a', 'c')")
    got = {r.id: r.final for r in expand.decayed(lineage, anchors, p, scored).collect()}
    assert got == {"x": round(0.3 * 0.5 + 0.7 * 0.8 * 0.9, 9), "b": 0.5}  # b has a score already


def test_type_filter_follows_intent(spark):
    pairs = spark.createDataFrame([(q, "ent::a") for q in (1, 2, 3)] + [(q, "ent::b") for q in (1, 2, 3)], "qid long, entity string")
    intents = spark.createDataFrame([(1, "HUM"), (2, "LOC"), (3, "OTHER")], "qid long, semantic string")
    edges = spark.createDataFrame([("ent::a", "type::PERSON", "IS_A"), ("ent::b", "type::LOCATION", "IS_A")], "src string, dst string, edge_type string")
    got = {(r.qid, r.entity) for r in expand.allowed_entities(pairs, intents, edges).collect()}
    assert got == {(1, "ent::a"), (2, "ent::b"), (3, "ent::a"), (3, "ent::b")}


def test_chunk_score_is_the_best_supporter_anywhere(spark):
    edges = spark.createDataFrame([("p", "c", "SUPPORTED_BY"), ("r", "c", "SUPPORTED_BY"), ("p", "d", "SUPPORTED_BY")], "src string, dst string, edge_type string")
    props = spark.createDataFrame([(1, "p", 0.2)], "qid long, id string, final double")
    scores = spark.createDataFrame([(1, "p", 0.2), (1, "r", 0.9)], "qid long, id string, final double")
    got = {r.chunk: r.c_score for r in evidence.chunk_scores(props, scores, edges).collect()}
    assert got == {"c": 0.9, "d": 0.2}


def test_induced_edges_have_both_ends_inside(spark):
    edges = spark.createDataFrame([("a", "b", "X"), ("b", "c", "X"), ("c", "a", "X")], "src string, dst string, edge_type string")
    nodes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "a")], "qid long, id string")
    assert {(r.qid, r.src, r.dst) for r in walk.induced(nodes, edges).collect()} == {(1, "a", "b"), (2, "c", "a")}


def test_documents_without_chunks_drop_after_the_cut(spark):
    ranked = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "qid long, doc_id long, rk long")
    chunks = spark.createDataFrame([(1, "", "x"), (1, "c", " "), (2, "d", "y")], "doc_id long, chunk_id string, text string")
    assert [r.doc_id for r in retrieve.clean_chunks(ranked, chunks).collect()] == [2]


def test_fusion_ignores_the_scale_of_scores(spark):
    a = spark.createDataFrame([(1, 1, 9.0, 1), (1, 2, 8.0, 2)], "qid long, doc_id long, score double, rk long")
    b = spark.createDataFrame([(1, 2, 0.3, 1)], "qid long, doc_id long, score double, rk long")
    one = {r.doc_id: r.score for r in retrieve.fuse_rrf([a, b]).collect()}
    two = {r.doc_id: r.score for r in retrieve.fuse_rrf([a.withColumn("score", F.col("score") * 100), b]).collect()}
    assert one == two and one[2] > one[1]
    assert {r.doc_id: r.score for r in retrieve.fuse(a, b, "linear").collect()} == {1: 4.5, 2: 4.15}


def test_merge_keeps_the_first_pass(spark):
    kind = "qid long, doc_id long, rk long"
    first, second = spark.createDataFrame([(1, 5, 1)], kind), spark.createDataFrame([(1, 5, 1), (1, 6, 2)], kind)
    rows = retrieve.merge_passes(first, second).orderBy("pos").collect()
    assert [(r.doc_id, r["pass"], r.pos) for r in rows] == [(5, 1, 1), (6, 2, 2)]


def test_invalid_model_answers_raise(spark):
    df = spark.createDataFrame([(1, '{"topology": "Parallel", "semantic": "hum"}')], "qid long, a string")
    assert intent.validated_intent(df, "a").first().semantic == "HUM"
    with pytest.raises(Exception, match="invalid topology"):
        intent.validated_intent(spark.createDataFrame([(1, '{"topology": "parallel", "semantic": "HUM"}')], "qid long, a string"), "a").collect()
    with pytest.raises(Exception, match="not a score"):
        rank.checked_scores(spark.createDataFrame([("1.5",)], "raw string")).collect()


def test_engine_reports_a_status_per_question(spark):
    chunks = small(spark)
    docs = chunks.groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    g = graph_tables(chunks, keep=True).stored()
    engine = Engine(build_index(docs, chunks), g, full_prior(g.edges))
    asked = spark.createDataFrame([(1, "Who met Robert in Paris?"), (2, " "), (3, "zzz qqq")], "qid long, text string")
    rows = {r.qid: r for r in engine.query(asked).collect()}
    assert (rows[1].status, rows[2].status, rows[3].status) == ("ok", "blank query", "no seed chunk")
    assert rows[1].n_proposition > 0 and "## Propositions" in rows[1].prompt and rows[1].answer
    assert rows[2].prompt is None and rows[3].n_chunk == 0
