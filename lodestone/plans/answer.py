"""The online plan: a batch of questions to evidence, prompts and answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import strip
from ..operators import evidence, expand, index, intent, rank, retrieve, walk
from ..operators.graph import Graph
from ..sources.store import load_required, materialize, path_exists


@dataclass
class Index:
    """``docs(doc_id, text)``, their ``chunks``, ``postings`` and, optionally, ``dense``."""

    chunks: DataFrame
    postings: DataFrame
    dense: DataFrame | None = None


def build_index(docs: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, keep: bool = True) -> Index:
    store = materialize if keep else (lambda df, tag: df)
    dense = None if vectors is None else store(index.dense_index(vectors, "doc_id", "embedding"), "dense")
    return Index(chunks, store(index.postings(docs, "doc_id", "text"), "postings"), dense)


@dataclass
class Engine:
    """Answers batches of ``questions(qid, text)``; ``vectors(qid, vec, norm)`` may hold theirs.

    ``classify``, ``score`` and ``answer`` are deterministic by default; those of
    ``operators.models`` ask a model."""

    index: Index
    graph: Graph
    prior: DataFrame
    config: Config = field(default_factory=Config)
    classify: Callable[..., DataFrame] = intent.heuristic_intent
    score: Callable[..., DataFrame] = rank.semantic_scores
    answer: Callable[[DataFrame], DataFrame] | None = None  # of prompts; None: the best proposition

    def hybrid(self, questions: DataFrame, k: int, vectors: DataFrame | None = None) -> DataFrame:
        """``(qid, doc_id, score, rk)``: both lists fused and cut to k."""
        c = self.config.retrieval
        terms = retrieve.query_terms(questions, "qid", "text")
        sparse = retrieve.sparse_top(retrieve.posted_terms(self.index.postings, terms), terms, c.top_k_sparse)
        if self.index.dense is None or vectors is None:
            return retrieve.top(retrieve.fuse_rrf([sparse], c.rrf_k), k, digits=9)
        dense = retrieve.dense_top(self.index.dense, vectors, c.top_k_dense)
        return retrieve.top(retrieve.fuse(dense, sparse, c.fusion_method, c.rrf_k, c.lambda_dense, c.lambda_sparse), k, digits=9)

    def coarse(self, questions: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """``(qid, doc_id, pos)`` of ``questions(qid, text, topology)``: one pass for parallel
        questions; for sequential ones a second pass with what the first found."""
        c = self.config.retrieval
        parallel, chained = questions.where("topology = 'Parallel'"), questions.where("topology = 'Sequential'")
        one = self.hybrid(parallel, c.parallel(), vectors and vectors.join(parallel.select("qid"), "qid", "left_semi"))
        own = vectors and vectors.join(chained.select("qid"), "qid", "left_semi")
        first = materialize(self.hybrid(chained, c.first_pass(), own), "pass1")
        more = retrieve.followup_queries(chained, first, self.index.chunks, c.followup_docs, c.followup_chunks, c.followup_chars)
        second = self.hybrid(more, c.second_pass(), own)
        both = retrieve.merge_passes(first, second).select("qid", "doc_id", "pos")
        return one.select("qid", "doc_id", F.col("rk").alias("pos")).unionByName(both)

    def select(self, questions: DataFrame, vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Questions with intent, status and the sizes on their way, and selected evidence."""
        r, e = self.config.ranking, self.config.evidence
        said = materialize(questions.select("qid", strip(F.coalesce("text", F.lit(""))).alias("text")), "said")
        live = materialize(self.classify(said.where("text <> ''")), "asked")
        asked = said.join(live.select("qid", "topology", "semantic"), "qid", "left")
        seeds = walk.seed_chunks(self.coarse(live, vectors), self.index.chunks, self.graph.texts("chunk"))
        seeds = materialize(seeds, "seeds")
        edges, nodes = self.graph.edges, self.graph.nodes
        first = materialize(walk.chunks_to_propositions(seeds, edges), "first")
        ents = materialize(walk.propositions_to_entities(first, edges), "ents")
        reached = materialize(walk.entities_to_propositions(ents, edges, first), "reached")
        texts = self.graph.texts("proposition")
        if self.score is rank.semantic_scores:
            scored = rank.scored_propositions(reached, live, texts, self.prior, r.score_text_chars, r.beta_struct, r.gamma_sem)
        else:
            sem = materialize(self.score(reached, live, texts, r.score_text_chars), "sem")
            scored = rank.proposition_scores(reached, sem, self.prior, r.beta_struct, r.gamma_sem)
        scored = materialize(scored, "scored")
        anchored = materialize(rank.anchors(scored, r.top_anchor_p, r.k_prop), "anchors")
        kept = rank.entity_ranking(expand.allowed(anchored, live, edges), self.prior, min(r.top_entity_expand, r.k_ent), r.beta_struct)
        grown = materialize(expand.grown(anchored, materialize(kept, "kept"), edges, self.prior, scored, r.expand_decay, r.expand_struct_mix), "grown")
        props = materialize(expand.final_propositions(anchored, grown, r.max_final_p), "props")
        scores = expand.all_scores(scored, grown)
        cited = materialize(evidence.chunks_per_proposition(evidence.leading_chunks(props, scores, edges, r.max_chunks_per_p), r.max_chunks_per_p), "cited")
        found = evidence.buckets(props, cited, edges, nodes)
        found = evidence.normalized(found, {"proposition": e.max_len_prop, "chunk": e.max_len_chunk, "entity": e.max_len_ent, "type": e.max_len_type})
        chosen = materialize(evidence.select_evidence(found, {"proposition": e.k_p, "entity": e.k_e, "chunk": e.k_c, "type": e.k_z}), "chosen")
        n = lambda df, c: df.groupBy("qid").agg(F.count("*").alias(c))
        every = seeds.unionByName(ents).unionByName(reached)  # the first are reached, too
        sizes = walk.subgraph_sizes(seeds, every, edges).join(n(first, "n_first"), "qid", "left").join(n(anchored, "n_anchor_props"), "qid", "left").join(n(props, "n_final_props"), "qid", "left")
        state = asked.join(materialize(sizes, "sizes"), "qid", "left")
        status = F.when(F.col("text") == "", "blank query").when(F.col("n_seed_chunks").isNull(), "no seed chunk").when(F.col("n_first").isNull(), "no proposition").otherwise("ok")
        counts = (F.coalesce(c, F.lit(0)).alias(c) for c in ("n_seed_chunks", "n_q_nodes", "n_q_edges", "n_anchor_props", "n_final_props"))
        return state.select("qid", "text", "topology", "semantic", status.alias("status"), *counts), chosen

    def query(self, questions: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
        """``(qid, topology, semantic, status, answer, prompt, supporting_nodes, metadata,
        n_proposition, ...)`` for every question. What stops a question (a blank text, no seed
        chunk, no proposition) is its status and stops no other."""
        asked, chosen = self.select(questions, vectors)
        prompts = evidence.prompts(asked.where("status = 'ok'"), chosen)
        if self.answer:
            prompts = materialize(prompts, "prompts")
            answers = self.answer(prompts)
        else:
            answers = evidence.extractive_answers(chosen)
        out = asked.join(answers, "qid", "left").join(prompts, "qid", "left").join(evidence.metadata(chosen), "qid", "left").join(evidence.supporting_nodes(chosen), "qid", "left")
        weights = (F.lit(self.config.ranking.gamma_sem).alias("gamma_sem"), F.lit(self.config.ranking.beta_struct).alias("beta_struct"))
        metadata = F.struct("n_seed_chunks", "n_q_nodes", "n_q_edges", "n_anchor_props", "n_final_props", *weights).alias("metadata")
        return out.select("qid", "topology", "semantic", "status", "answer", "prompt", "supporting_nodes", metadata, *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in ("proposition", "entity", "chunk", "type")))

    def save(self, path: str) -> None:
        """Every table under ``path``."""
        save_index(self.index, path)
        save_graph(self.graph, self.prior, path)


def save_index(index: Index, path: str) -> None:
    """Chunks, vectors and postings; these are clustered by term, so that a later filter on it
    skips files and row groups, and come last, so that their marker stands for all."""
    for name, df in (("chunks", index.chunks), ("dense", index.dense)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")


def save_graph(graph: Graph, prior: DataFrame, path: str) -> None:
    """Nodes, the prior and, last, the edges in a folder per type."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    prior.write.mode("overwrite").parquet(f"{path}/prior")
    graph.edges.repartition("edge_type", F.pmod(F.xxhash64("src"), F.lit(32))).write.mode("overwrite").partitionBy("edge_type").parquet(f"{path}/edges")


def load_index(spark: SparkSession, path: str) -> Index:
    """An index that was saved; a table that is missing is an error."""
    dense = load_required(spark, f"{path}/dense") if path_exists(spark, f"{path}/dense/_SUCCESS") else None
    return Index(load_required(spark, f"{path}/chunks"), load_required(spark, f"{path}/postings"), dense)


def load_graph(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """A graph that was saved, and its prior."""
    return Graph(load_required(spark, f"{path}/nodes"), load_required(spark, f"{path}/edges")), load_required(spark, f"{path}/prior")


def load_engine(spark: SparkSession, path: str, config: Config | None = None, graph_path: str | None = None) -> Engine:
    """An engine that was saved, its graph in the same folder or in another."""
    return Engine(load_index(spark, path), *load_graph(spark, graph_path or path), config or Config())
