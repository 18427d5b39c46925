import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions.providers import HttpModel
from lodestone.operators import extract, graph, models
from lodestone.plans import app
from lodestone.plans.answer import Engine, build_index, load_engine
from lodestone.plans.build import full_prior, graph_tables, mentioned
from tests.core.test_graph import small


def reply(url, body, timeout):
    p = body["prompt"]
    if p.startswith("Say how"):
        return {"response": '```json\n{"topology": "Parallel", "semantic": "loc"}\n```'}
    if p.startswith("List the named"):
        return {"response": 'Here: {"entities": ["Robert", " "], "facts": [{"fact": "Robert {lives} here", "triplets": [["Robert", "lives", "here"], ["x"]]}]}'}
    if p.startswith("Which of"):
        return {"response": '{"type": "location"}' if "Paris" in p.split("Entity: ")[1][:8] else '{"type": "OTHER"}'}
    if p.startswith("How much"):
        return {"response": " 0.5 "}
    return {"response": "answer "}


def fake():
    return HttpModel("http://nowhere", "m", transport=reply)


def test_model_backed_engine(spark):
    chunks = small(spark)
    g = graph_tables(chunks, keep=True).stored()
    docs = chunks.groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    m = fake()
    e = Engine(build_index(docs, chunks), g, full_prior(g.edges), classify=models.model_intent(m), score=models.model_scores(m), answer=models.model_answers(m))
    rows = {r.qid: r for r in e.query(spark.createDataFrame([(1, "Where is Paris"), (2, "")], "qid long, text string")).collect()}
    assert (rows[1].semantic, rows[1].topology, rows[1].answer, rows[1].status) == ("LOC", "Parallel", "answer", "ok")
    assert rows[2].status == "blank query" and rows[2].answer is None


def test_model_extraction_and_types(spark):
    rows = models.model_extraction(fake())(small(spark).where("chunk_id = 'c0'")).first()
    assert rows.entities == ["Robert"] and rows.facts[0].fact == "Robert {lives} here" and len(rows.facts[0].triplets) == 1
    bad = HttpModel("x", "m", transport=lambda *a: {"response": "no json"})
    with pytest.raises(ValueError, match="no_entities"):
        models.model_extraction(bad)(small(spark).where("chunk_id = 'c0'"))
    ents = graph.entity_nodes(mentioned(small(spark)))
    cache = spark.createDataFrame([("berlin", "PERSON"), ("robert", "PLANET")], "canonical string, label string")
    got = {r.canonical: r.label for r in models.model_types(fake(), ents, cache, ("PERSON", "LOCATION", "OTHER")).collect()}
    assert got["berlin"] == "PERSON" and got["paris"] == "LOCATION" and got["robert"] == "OTHER"
    with pytest.raises(Exception, match="not an allowed type"):
        models.model_types(bad, ents, cache, ("PERSON",)).collect()
    assert extract.facts(models.model_extraction(fake())(small(spark).where("chunk_id = 'c0'"))).first().entities == ["Robert"]


def test_saved_engine_answers_alike(spark, tmp_path):
    chunks = small(spark)
    g = graph_tables(chunks, keep=True).stored()
    docs = chunks.groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    e = Engine(build_index(docs, chunks), g, full_prior(g.edges))
    asked = spark.createDataFrame([(1, "Who met Robert in Paris?")], "qid long, text string")
    path = f"file://{tmp_path}/e"
    with pytest.raises(FileNotFoundError):
        load_engine(spark, path)
    e.save(path)
    assert load_engine(spark, path).query(asked).collect() == e.query(asked).collect()


def test_command_line_run(spark, tmp_path):
    qa = [{"_id": f"q{i}", "question": f"Where does Person{'abc'[i]} live?", "answer": "x", "context": [[f"Title{i}", ["Robert lives in Paris.", "Maria was in Berlin with Robert."]]], "supporting_facts": [[f"Title{i}", 0]]} for i in range(3)]
    (tmp_path / "qa.json").write_text(json.dumps(qa))
    args = app.parser().parse_args(["--qa", f"{tmp_path}/qa.json", "--num-questions", "2", "--engine", f"file://{tmp_path}/e", "--output", f"file://{tmp_path}/out", "--query", "Where was Robert"])
    row = app.run(spark, args).first()
    assert row.status == "ok" and row.question == "Where was Robert" and row.n_chunk > 0
    assert row.metadata.n_seed_chunks > 0 and row.metadata.n_q_nodes > row.metadata.n_seed_chunks and row.metadata.gamma_sem == 0.5
    assert {n.node_type for n in row.supporting_nodes} >= {"chunk", "proposition", "entity"}
    assert row.run_context.selected_qa_ids == ["q0", "q1"] and row.run_context.query == "Where was Robert"
    args.query = None
    assert app.run(spark, args).first().question == qa[0]["question"]
    args.query, args.use_first_question_query = "Where was Robert", True
    args.graph_output, args.type_cache, args.rebuild_index = f"file://{tmp_path}/g", f"file://{tmp_path}/types", True
    assert app.run(spark, args).first().question == qa[0]["question"]
    assert (tmp_path / "g" / "edges").exists() and not (tmp_path / "g" / "postings").exists()
    types = {r.canonical: r.label for r in app.readers.read_type_cache(spark, args.type_cache).collect()}
    assert types.keys() >= {"robert", "paris", "berlin"}
    app.readers.write_type_cache(spark.createDataFrame([("robert", "LOCATION"), ("else", "PERSON")], "canonical string, label string"), args.type_cache)
    args.rebuild_graph = True
    assert app.run(spark, args).first().status == "ok"
    again = {r.canonical: r.label for r in app.readers.read_type_cache(spark, args.type_cache).collect()}
    assert again == types | {"robert": "LOCATION", "else": "PERSON"}
    args.num_questions = 0
    with pytest.raises(ValueError):
        app.run(spark, args)
