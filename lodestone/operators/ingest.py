"""From samples with nested context to documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def context_entries(samples: DataFrame) -> DataFrame:
    """One row per context entry with a title that is not blank, with its position."""
    rows = samples.select("qa_id", "question", "answer", "supporting_facts", F.posexplode("context").alias("pos", "entry"))
    rows = rows.withColumn("title", strip(F.coalesce("entry.title", F.lit(""))))
    return rows.where("title <> ''").withColumn("sents", F.col("entry.sents")).drop("entry")


def first_titles(entries: DataFrame) -> DataFrame:
    """Of the entries of a sample that share a title the first."""
    w = Window.partitionBy("qa_id", "title").orderBy("pos")
    return entries.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def document_id(qa_id: Column | str, title: Column | str) -> Column:
    return F.concat_ws("::", F.lit("D"), qa_id, title)


def chunk_id(qa_id: Column | str, title: Column | str, idx: Column | str) -> Column:
    return F.concat_ws("::", F.lit("C"), qa_id, title, F.concat(F.lit("s"), F.col(idx) if isinstance(idx, str) else idx))


def explode_chunks(entries: DataFrame) -> DataFrame:
    """One row per sentence that is not blank; indexes are those before blanks go.

    A chunk supports its sample if (title, index) is among the supporting facts, which stay
    an array of the row: membership needs no join.
    """
    rows = entries.select("*", F.posexplode("sents").alias("sent_idx", "sent")).withColumn("text", strip("sent")).where("text <> ''")
    said = F.transform(F.coalesce("supporting_facts", F.array().cast("array<struct<title:string,sent_idx:int>>")), lambda f: F.struct(strip(f["title"]).alias("title"), f["sent_idx"].alias("sent_idx")))
    support = F.array_contains(said, F.struct(F.col("title"), F.col("sent_idx")))
    return rows.select(chunk_id("qa_id", "title", "sent_idx").alias("id"), "text", "title", "sent_idx", "qa_id", "question", "answer", F.coalesce(support, F.lit(False)).alias("is_supporting"), "pos")


def documents(samples: DataFrame, dedup_by_title: bool = True) -> DataFrame:
    """``(id, title, qa_id, question, answer, chunks)``; the chunks of an entry are made in
    its row, so nothing is collected. Entries without a sentence give no document."""
    entries = context_entries(samples)
    entries = first_titles(entries) if dedup_by_title else entries
    said = F.coalesce("supporting_facts", F.array().cast("array<struct<title:string,sent_idx:int>>"))
    chunk = lambda x, i: F.struct(
        chunk_id("qa_id", "title", i).alias("id"),
        strip(F.coalesce(x, F.lit(""))).alias("text"),
        F.col("title"),
        i.alias("sent_idx"),
        F.col("qa_id"),
        F.col("question"),
        F.col("answer"),
        F.exists(said, lambda f: (strip(f["title"]) == F.col("title")) & (f["sent_idx"] == i)).alias("is_supporting"),
    )
    chunks = F.filter(F.transform("sents", chunk), lambda c: c["text"] != "")
    rows = entries.select(document_id("qa_id", "title").alias("id"), "title", "qa_id", "question", "answer", chunks.alias("chunks"))
    return rows.where(F.size("chunks") > 0)


def documents_to_chunks(docs: DataFrame) -> DataFrame:
    """The flat chunks of documents; those without an id or a text are left out."""
    return docs.select(F.explode("chunks").alias("c")).select("c.*").where("id <> '' and text <> ''")


def chunks(samples: DataFrame, dedup_by_title: bool = True) -> DataFrame:
    return documents_to_chunks(documents(samples, dedup_by_title))


def first_groups(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n distinct groups in order of appearance: a partial aggregate and a top-k."""
    if n <= 0:
        raise ValueError("n must be positive")
    return rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(order).alias("first_seen")).orderBy("first_seen", group).limit(n)


def keep_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    return rows.join(groups.select(key), key, "left_semi")


def subset_summary(rows: DataFrame, group: str, doc: str) -> DataFrame:
    return rows.groupBy(group).agg(F.countDistinct(doc).alias("n_docs"), F.count("*").alias("n_chunks"))


def keep_first(rows: DataFrame, key: str, *order: str, within: str | None = None) -> DataFrame:
    """One row per key, the first in order; rows whose key is null or blank are left out."""
    by = [key] if within is None else [within, key]
    rows = rows.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("rn = 1").drop("rn")
