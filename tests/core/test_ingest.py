import json

import pytest
from pyspark.sql import functions as F

from lodestone.config import clean_labels, from_mapping, load_config
from lodestone.operators import ingest
from lodestone.sources import readers, store

SAMPLE = "qa_id string, question string, answer string, context array<struct<title:string,sents:array<string>>>, supporting_facts array<struct<title:string,sent_idx:int>>"


@pytest.fixture
def samples(spark):
    rows = [
        ("q1", "why", "so", [("A", ["a0", " ", "a2"]), (" A ", ["other"]), (" ", ["x"]), ("B", [None, "b1"]), ("C", [" "])], [("A", 2), (" B", 1), ("Z", 0)]),
        ("q2", "who", "me", [("A", ["same title, other sample"])], None),
    ]
    return spark.createDataFrame(rows, SAMPLE)


def test_documents_keep_first_titles_and_indexes(samples):
    docs = {r.id: [(c.id, c.text, c.sent_idx, c.is_supporting) for c in r.chunks] for r in ingest.documents(samples).collect()}
    assert docs == {
        "D::q1::A": [("C::q1::A::s0", "a0", 0, False), ("C::q1::A::s2", "a2", 2, True)],
        "D::q1::B": [("C::q1::B::s1", "b1", 1, True)],
        "D::q2::A": [("C::q2::A::s0", "same title, other sample", 0, False)],
    }
    assert ingest.documents(samples, dedup_by_title=False).count() == 4


def test_both_ways_to_chunks_agree(samples):
    flat = ingest.explode_chunks(ingest.first_titles(ingest.context_entries(samples))).drop("pos")
    nested = ingest.chunks(samples).select(flat.columns)
    assert sorted(map(str, flat.collect())) == sorted(map(str, nested.collect()))


def test_first_groups_follow_appearance(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 0), ("c", 4)], "g string, o long")
    assert [r.g for r in ingest.first_groups(df, "g", "o", 2).collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        ingest.first_groups(df, "g", "o", 0)


def test_json_sources_round_trip(spark, tmp_path):
    data = [{"_id": " q ", "question": "Q", "answer": "A", "context": [["T", ["s0", "s1"]], ["bad"], "worse"], "supporting_facts": [["T", 1], ["T"]]}]
    path = tmp_path / "qa.json"
    path.write_text(json.dumps([{**data[0], "context": data[0]["context"][:2]}]))
    row = readers.read_samples(spark, str(path)).first()
    assert row.qa_id == "q" and [(c.title, c.sents) for c in row.context] == [("T", ["s0", "s1"])]
    assert [(f.title, f.sent_idx) for f in row.supporting_facts] == [("T", 1)]
    docs = ingest.documents(readers.read_samples(spark, str(path)))
    readers.write_json(docs, str(tmp_path / "docs"))
    again = spark.read.schema(readers.DOCUMENT).json(str(tmp_path / "docs"))
    assert ingest.documents_to_chunks(again).count() == 2


def test_last_question_wins(spark):
    df = spark.createDataFrame([("a ", 1, "old"), ("a", 2, "new"), (" ", 3, "x"), (None, 4, "y")], "k string, o long, q string")
    assert [tuple(r) for r in readers.last_questions(df, "k", "o", "q").collect()] == [("a", "new")]


def test_type_cache_is_cleaned(spark):
    df = spark.createDataFrame([('{" x ": "person", "y": " ", " ": "LOC"}',)], "value string")
    assert [tuple(r) for r in readers.clean_type_cache(df).collect()] == [("x", "PERSON")]
    with pytest.raises(Exception):
        readers.clean_type_cache(spark.createDataFrame([("[1",)], "value string")).collect()


def test_type_cache_is_stored_and_extended(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    assert readers.read_type_cache(spark, path).count() == 0
    kind = "canonical string, label string"
    cache, typed = spark.createDataFrame([("a", "PERSON")], kind), spark.createDataFrame([("a", "OTHER"), ("b c", "LOCATION")], kind)
    readers.write_type_cache(readers.merged_type_cache(cache, typed), path)
    assert sorted(map(tuple, readers.read_type_cache(spark, path).collect())) == [("a", "PERSON"), ("b c", "LOCATION")]


def test_load_or_build_builds_once(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(5)

    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        store.load_required(spark, path)
    for rebuild in (False, False, True):
        assert store.load_or_build(spark, path, build, rebuild, sort_by="id").count() == 5
    assert len(made) == 2 and store.load_required(spark, path).count() == 5


def test_config_is_checked(tmp_path):
    assert clean_labels([" person", "PERSON", "loc"]) == ("LOC", "PERSON")
    assert from_mapping({"retrieval": {"top_k_final": 7}}).retrieval.top_k_final == 7
    for bad in ({"nope": {}}, {"ranking": {"nope": 1}}, [], {"graph": {"entity_type_labels": [" "]}}):
        with pytest.raises(ValueError):
            from_mapping(bad)
    (tmp_path / "c.json").write_text('{"evidence": {"k_p": 1}}')
    assert load_config(str(tmp_path / "c.json")).evidence.k_p == 1


def test_keep_first_drops_blank_keys(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("", 0), (None, 0)], "k string, o long")
    assert [tuple(r) for r in ingest.keep_first(df, "k", "o").collect()] == [("a", 1)]
    assert ingest.keep_first(df.withColumn("w", F.col("o")), "k", "o", within="w").count() == 2


def test_discarded_tables_are_gone_and_others_stay(spark):
    from pathlib import Path

    from lodestone.sources.store import discard, materialize, stored_as

    one, two = (materialize(spark.range(3), "t") for _ in range(2))
    at = [Path(t._stored_at.removeprefix("file://")) for t in (one, two)]
    discard(spark.range(2), stored_as(one.select("id"), one), one)
    assert not at[0].exists() and at[1].exists() and two.count() == 3
