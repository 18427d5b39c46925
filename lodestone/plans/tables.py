"""The engine's inputs from the tables at hand: documents, their paragraphs, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SENTENCE_END, strip
from ..sources.store import read_table


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.col("source").alias("qa_id"), F.coalesce("text", F.lit("")).alias("text"))


def chunks_of(docs: DataFrame) -> DataFrame:
    """``(chunk_id, doc_id, qa_id, ord, text)``: paragraphs that are not blank."""
    rows = docs.select("doc_id", "qa_id", F.posexplode(F.split("text", "\n")).alias("ord", "raw")).withColumn("text", strip("raw")).where("text <> ''")
    key = F.concat(F.lit("C::"), "qa_id", F.lit("::"), F.col("doc_id").cast("string"), F.lit("::s"), F.col("ord").cast("string"))
    return rows.select(key.alias("chunk_id"), "doc_id", "qa_id", "ord", "text")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(documents(spark, d))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """A document's vector is the one with its number."""
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a sample whose question is its first paragraph and whose context
    entries are its paragraphs: the title is what stands before the first blank, the sentences
    are split off. The first sentence of the
    first two titled paragraphs supports the sample."""
    rows = read_table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pars = F.split("text", "\n")
    entry = F.transform(pars, lambda p: F.struct(F.element_at(F.split(p, " "), 1).alias("title"), F.split(p, SENTENCE_END).alias("sents")))
    rows = rows.select(F.col("doc_id").cast("string").alias("qa_id"), F.element_at(pars, 1).alias("question"), F.lit("").alias("answer"), entry.alias("context"))
    support = F.transform(F.slice("context", 1, 2), lambda e: F.struct(e["title"].alias("title"), F.lit(0).alias("sent_idx")))
    return rows.withColumn("supporting_facts", support)


def type_cache(entities: DataFrame) -> DataFrame:
    """A cache as a former run may have left it: labels of the entities that begin with a
    vowel, one of the labels not allowed."""
    size = F.length("canonical")
    label = F.when(size < 7, "PERSON").when(size < 9, "LOCATION").when(size < 11, "OTHER").otherwise("UNKNOWN")
    return entities.where(F.col("canonical").rlike("^[aeiou]")).select("canonical", label.alias("label"))
