"""Index tables: vectors with norms, and postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_tokens, blank_to_null, join_first, tokens
from ..functions.vector import norm


def document_text(text: Column | str | None, chunk_texts: Column | str, chunks: int = 12, chars: int = 2000) -> Column:
    """The document's own text, else its first chunks joined and cut, else a blank."""
    parts = [] if text is None else [blank_to_null(text)]
    return F.coalesce(*parts, F.nullif(join_first(chunk_texts, chunks, chars), F.lit("")), F.lit(" "))


def dense_index(vectors: DataFrame, doc: str, vec: str) -> DataFrame:
    """``(doc_id, vec, norm)``; a row without a vector is left out."""
    return vectors.where(F.col(vec).isNotNull()).select(F.col(doc).alias("doc_id"), F.col(vec).alias("vec"), norm(F.col(vec)).alias("norm"))


def dimension_violations(vectors: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows whose vector is missing, of another length, or holds a null or a non-number."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x))
    return vectors.where(F.col(vec).isNull() | (F.size(vec) != dim) | F.coalesce(bad, F.lit(True)))


def postings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``(term, doc_id, w)`` with weight 1 per distinct term; no shuffle."""
    return docs.select(F.col(doc).alias("doc_id"), F.explode(tokens(text)).alias("term")).select("term", "doc_id", F.lit(1.0).alias("w"))


def term_counts(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``(term, doc_id, tf)``: rows are dealt out by document as texts, so that its terms are
    counted where they are and no posting is shuffled."""
    return docs.select(doc, text).repartition(doc).select(F.col(doc).alias("doc_id"), F.explode(all_tokens(text)).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def weighted_postings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``(term, doc_id, w)`` with w = (1 + ln tf) * ln(N / df), six digits."""
    counts = term_counts(docs, doc, text)
    total = docs.agg(F.countDistinct(doc).alias("n_docs"))
    rows = counts.join(document_frequencies(counts), "term").crossJoin(total)  # total: one row
    w = (1 + F.log(F.col("tf").cast("double"))) * F.log(F.col("n_docs") / F.col("df"))
    return rows.select("term", "doc_id", F.round(w, 6).alias("w"))
