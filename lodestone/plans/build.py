"""The offline plan: chunks to a graph with its prior."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Graph as GraphConfig
from ..operators import extract, graph, prior
from ..sources.store import materialize


def mentioned(chunks: DataFrame) -> DataFrame:
    """``(entity, doc_id, ord, pos, chunk_id, chunk_text)``, one row per mention of a chunk."""
    return chunks.select("chunk_id", "doc_id", "ord", F.col("text").alias("chunk_text"), F.posexplode(extract.mentions("text")).alias("pos", "entity"))


@dataclass
class GraphTables:
    """Lazy tables of a graph over chunks; ``stored`` writes those that are used again. The
    typed entities and the links are made when they are first asked for: the skeleton does not
    need them, nor does the graph all links."""

    chunks: DataFrame
    bound: DataFrame
    texts: DataFrame
    made_links: Callable[[], DataFrame]
    pairs: DataFrame
    made_typed: Callable[[], DataFrame]

    @cached_property
    def links(self) -> DataFrame:
        return self.made_links()

    @cached_property
    def typed(self) -> DataFrame:
        return self.made_typed()

    @property
    def supports(self) -> DataFrame:
        return graph.support_edges(graph.proposition_links(self.bound, self.texts))

    @property
    def nodes(self) -> DataFrame:
        kinds = (
            self.chunks.select(F.col("chunk_id").alias("id"), F.lit("chunk").alias("node_type"), "text"),
            self.texts.groupBy(F.col("prop_id").alias("id")).agg(F.min("prop_text").alias("text")).select("id", F.lit("proposition").alias("node_type"), "text"),
            self.typed.select("id", F.lit("entity").alias("node_type"), "text"),
            graph.type_nodes(self.typed).select("id", F.lit("type").alias("node_type"), "text"),
        )
        out = kinds[0]
        for k in kinds[1:]:
            out = out.unionByName(k)
        return out

    @property
    def edges(self) -> DataFrame:
        return self.supports.unionByName(graph.assertion_edges(self.pairs)).unionByName(graph.type_edges(self.typed))

    def stored(self) -> graph.Graph:
        return graph.Graph(materialize(self.nodes, "nodes"), materialize(self.edges, "edges"))


def graph_tables(chunks: DataFrame, cache: DataFrame | Callable[[DataFrame], DataFrame] | None = None, config: GraphConfig | None = None, keep: bool = False, extractor=extract.heuristic_extraction) -> GraphTables:
    """The graph of ``chunks(chunk_id, doc_id, ord, text)``. With ``keep`` the facts and the
    tables that others derive from are written first. ``cache`` are labels of entities, or makes
    them of the entities."""
    config = config or GraphConfig()
    store = (lambda df, tag: materialize(df, tag)) if keep else (lambda df, tag: df)
    extracted = extractor(chunks)
    plain = keep and extractor is extract.heuristic_extraction
    if plain:
        facts = store(extract.heuristic_facts(chunks), "facts")
        bound = extract.bound_entities(facts)
    else:
        # only a chunk's own entities are bound to its facts, so those without any are left out first
        bound = store(extract.fact_entities(extract.facts(extracted.where(F.size("entities") > 0))), "bound")
    texts = store(graph.proposition_texts(bound, config.texts_per_proposition), "texts")
    pairs = graph.asserted_together(facts, texts) if plain else None
    pairs = store(graph.asserted(graph.proposition_links(bound, texts), bound) if pairs is None else pairs, "pairs")

    def typed() -> DataFrame:
        mentions = extract.first_mentions(chunks, config.type_context_chars) if plain else extracted.select("chunk_id", "doc_id", "ord", F.substring("text", 1, config.type_context_chars).alias("chunk_text"), F.posexplode("entities").alias("pos", "entity"))
        ents = graph.entity_nodes(mentions)
        if callable(cache):
            ents = store(ents, "ents")
            known = cache(ents)
        else:
            known = chunks.sparkSession.createDataFrame([], "canonical string, label string") if cache is None else cache
        return store(graph.type_entities(ents, known, config.entity_type_labels, config.type_context_chars), "typed")

    return GraphTables(chunks, bound, texts, lambda: store(graph.proposition_links(bound, texts), "links"), pairs, typed)


def full_prior(edges: DataFrame, config: GraphConfig | None = None) -> DataFrame:
    config = config or GraphConfig()
    return prior.structural_prior(prior.skeleton(edges), config.alpha_core, config.alpha_betw, config.betweenness_pivots).select("id", F.round("s_struct", 9).alias("s_struct"))
