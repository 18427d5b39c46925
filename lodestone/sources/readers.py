"""JSON sources and sinks of question-answering data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, strip
from .store import path_exists

SAMPLE = "_id string, question string, answer string, context array<array<string>>, supporting_facts array<array<string>>"
CHUNK = "id string, text string, title string, sent_idx int, qa_id string, question string, answer string, is_supporting boolean"
DOCUMENT = f"id string, title string, qa_id string, question string, answer string, chunks array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in CHUNK.split(','))}>>"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a JSON array: ``(qa_id, question, answer, context, supporting_facts)``.

    Context entries are two-element arrays [title, [sentence, ...]] of mixed kinds; they are
    read as text and their second element parsed as JSON. Malformed entries are left out.
    """
    rows = spark.read.schema(SAMPLE).json(path, multiLine=True)
    pairs = F.filter("context", lambda x: (F.size(x) == 2) & F.element_at(x, 2).startswith("["))
    context = F.transform(pairs, lambda x: F.struct(F.element_at(x, 1).alias("title"), F.from_json(F.element_at(x, 2), "array<string>").alias("sents")))
    facts = F.filter("supporting_facts", lambda x: F.size(x) == 2)
    facts = F.transform(facts, lambda x: F.struct(F.element_at(x, 1).alias("title"), F.element_at(x, 2).try_cast("int").alias("sent_idx")))
    return rows.select(strip("_id").alias("qa_id"), strip("question").alias("question"), strip("answer").alias("answer"), context.alias("context"), facts.alias("supporting_facts"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).json(path, multiLine=True)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path, multiLine=True)


def last_questions(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """One row per stripped key, the last in order; blank keys are left out."""
    rows = rows.withColumn(key, blank_to_null(F.col(key).cast("string"))).where(F.col(key).isNotNull())
    last = rows.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("last"))
    return last.select(key, *(f"last.{v}" for v in values))


def clean_type_cache(rows: DataFrame, json: str = "value") -> DataFrame:
    """``(canonical, label)`` of JSON objects: keys stripped, labels upper-cased, blanks out.

    A text that is not an object raises an error."""
    parsed = F.from_json(F.col(json), "map<string,string>", {"mode": "FAILFAST"})
    pairs = rows.select(F.explode(F.map_entries(parsed)).alias("e"))
    pairs = pairs.select(strip("e.key").alias("canonical"), F.upper(strip("e.value")).alias("label"))
    return pairs.where("canonical <> '' and label <> ''").distinct()


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, UTF-8, nulls kept; the folder is made where needed."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def merged_type_cache(cache: DataFrame, typed: DataFrame) -> DataFrame:
    """``(canonical, label)``: what is cached stays, newly typed entities are added."""
    fresh = typed.select("canonical", "label").join(cache, "canonical", "left_anti")
    return cache.select("canonical", "label").unionByName(fresh).dropDuplicates(["canonical"])


def write_type_cache(cache: DataFrame, path: str) -> None:
    """One JSON object per entity, which ``clean_type_cache`` reads back as text."""
    cache.select(F.to_json(F.create_map("canonical", "label")).alias("value")).write.mode("overwrite").text(path)


def read_type_cache(spark: SparkSession, path: str) -> DataFrame:
    """A stored cache; an absent one is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "canonical string, label string")
    return clean_type_cache(spark.read.text(path))
