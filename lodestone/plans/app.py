"""The command line: build or load index and graph, answer a question, write the result.

    python -m lodestone --docs docs.json --chunks chunks.json --query "..." --output out
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, load_config
from ..functions.providers import hash_embeddings
from ..functions.text import strip
from ..functions.vector import norm
from ..operators import index, ingest
from ..operators.graph import Graph
from ..sources import readers
from ..sources.store import materialize, path_exists
from .answer import Index, build_index, load_engine, save_graph, save_index
from .build import full_prior, graph_tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    p.add_argument("--config", help="YAML or JSON; defaults apply without it")
    p.add_argument("--qa", help="JSON array of samples: the questions' texts, and docs and chunks where none are given")
    p.add_argument("--docs", help="JSON array of documents with chunks")
    p.add_argument("--chunks", help="JSON array of flat chunks; by default those of the documents")
    p.add_argument("--num-questions", type=int, default=5, help="keep the first N question ids")
    p.add_argument("--query", help="the question; by default the first of the subset")
    p.add_argument("--use-first-question-query", action="store_true", help="ask the first question of the subset, whatever --query says")
    p.add_argument("--engine", required=True, help="folder of the index and the graph")
    p.add_argument("--index-prefix", help="folder of the index, if not that of --engine")
    p.add_argument("--graph-output", help="folder of the graph, if not that of --engine")
    p.add_argument("--type-cache", help="folder of known entity types, read before and added to after a build")
    p.add_argument("--rebuild", action="store_true", help="build both even if they are there")
    p.add_argument("--rebuild-index", action="store_true")
    p.add_argument("--rebuild-graph", action="store_true")
    p.add_argument("--output", required=True, help="folder for the result, as JSON")
    p.add_argument("--verbose", action="store_true", help="log at level INFO")
    return p


def flat(chunks: DataFrame) -> DataFrame:
    """Chunks as the engine takes them: documents get numbers by a hash of their id."""
    doc = F.xxhash64("qa_id", "title")
    return chunks.select(F.col("id").alias("chunk_id"), doc.alias("doc_id"), "qa_id", F.col("sent_idx").cast("long").alias("ord"), strip("text").alias("text")).where("text <> ''")


def index_of(docs: DataFrame, chunks: DataFrame, config: Config) -> Index:
    """The index of documents and their chunks, with hashed embeddings."""
    texts = F.transform("chunks", lambda c: c["text"])
    r = config.retrieval
    whole = docs.select(F.xxhash64("qa_id", "title").alias("doc_id"), index.document_text(None, texts, r.fallback_chunks, r.fallback_chars).alias("text"))
    vectors = hash_embeddings(whole, "doc_id", "text").withColumnRenamed("vec", "embedding")
    return build_index(whole, flat(chunks), vectors)


def graph_of(spark: SparkSession, chunks: DataFrame, config: Config, type_cache: str | None) -> tuple[Graph, DataFrame]:
    """The graph of chunks and its prior; entity types that a cache holds are not asked again."""
    cache = materialize(readers.read_type_cache(spark, type_cache), "cache") if type_cache else None
    made = graph_tables(flat(chunks), cache, config.graph, keep=True)
    g = made.stored()
    if type_cache:
        readers.write_type_cache(readers.merged_type_cache(cache, made.typed), type_cache)
    return g, full_prior(g.edges, config.graph)


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.verbose:
        spark.sparkContext.setLogLevel("INFO")
    config = load_config(args.config) if args.config else Config()
    samples = readers.read_samples(spark, args.qa) if args.qa else None
    if args.docs:
        docs = readers.read_documents(spark, args.docs)
    elif samples is not None:
        docs = ingest.documents(samples)
    else:
        raise ValueError("--qa or --docs is needed")
    chunks = readers.read_chunks(spark, args.chunks) if args.chunks else ingest.documents_to_chunks(docs)
    groups = ingest.first_groups(chunks.withColumn("at", F.monotonically_increasing_id()), "qa_id", "at", args.num_questions)
    docs, chunks = ingest.keep_groups(docs, groups, "qa_id"), ingest.keep_groups(chunks, groups, "qa_id")
    if chunks.isEmpty() or docs.isEmpty():
        raise ValueError("no documents or chunks are left")
    ids = [r.qa_id for r in groups.orderBy("first_seen").collect()]  # at most --num-questions
    asked = None if args.use_first_question_query else args.query
    if not asked:
        known = docs.select("qa_id", "question", F.lit(0).alias("at"))
        if samples is not None:
            known = readers.last_questions(samples.withColumn("at", F.monotonically_increasing_id()), "qa_id", "at", "question")
        first = known.join(groups, "qa_id").where("question <> ''").orderBy("first_seen").select("question").first()
        if first is None:
            raise ValueError("no question is given and the subset has none")
        asked = first[0]
    index_at, graph_at = args.index_prefix or args.engine, args.graph_output or args.engine
    if args.rebuild or args.rebuild_index or not path_exists(spark, f"{index_at}/postings/_SUCCESS"):
        save_index(index_of(docs, chunks, config), index_at)
    if args.rebuild or args.rebuild_graph or not path_exists(spark, f"{graph_at}/edges/_SUCCESS"):
        save_graph(*graph_of(spark, chunks, config, args.type_cache), graph_at)
    engine = load_engine(spark, index_at, config, graph_at)
    question = spark.createDataFrame([(0, asked)], "qid long, text string")
    vectors = hash_embeddings(question, "qid", "text").withColumn("norm", norm(F.col("vec")))
    context = {"config": args.config, "docs": args.docs, "chunks": args.chunks, "qa": args.qa, "num_questions": args.num_questions, "graph_output": graph_at, "index_prefix": index_at, "query": asked}
    fields = [F.lit(v).cast("long" if isinstance(v, int) else "string").alias(k) for k, v in context.items()]
    selected = F.array(*(F.lit(i) for i in ids)).alias("selected_qa_ids")
    result = engine.query(question, vectors).withColumn("question", F.lit(asked)).withColumn("run_context", F.struct(*fields, selected))
    readers.write_json(result, args.output)
    return spark.read.json(args.output)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    for row in run(spark, args).select("question", "status", "answer", "run_context").collect():  # one question
        print(f"{row.question}\n[{row.status}] {row.answer}\nquestions: {', '.join(row.run_context.selected_qa_ids)}\nresult: {args.output}")
