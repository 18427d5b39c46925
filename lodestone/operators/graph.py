"""The evidence graph: nodes ``(id, node_type, text)`` and edges ``(src, dst, edge_type)``.

Links stay relational: what an entity, a fact or a chunk contributes to a proposition is a
row of a link table and not an element of an array, so a very common entity makes many rows
and never one large one. Arrays are made only by ``proposition_rows``, on demand.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_id, normalize_entity, proposition_id, strip, type_id


def proposition_texts(bound: DataFrame, first: int = 10) -> DataFrame:
    """``(entity, prop_id, prop_text)``: an entity's first distinct fact texts, in order.

    Repeated texts are folded by a pre-aggregated minimum and the cut by rank runs before
    the shuffle too, so a common entity moves at most ``first`` rows per task.
    """
    texts = bound.groupBy("entity", "text").agg(F.min(F.struct("doc_id", "ord", "idx")).alias("at"))
    w = Window.partitionBy("entity").orderBy("at", "text")
    some = texts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= first)
    joined = some.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("rn", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["text"]), " ")
    return joined.select("entity", text.alias("prop_text")).select("entity", proposition_id("prop_text").alias("prop_id"), "prop_text")


def proposition_links(bound: DataFrame, texts: DataFrame) -> DataFrame:
    """``(prop_id, entity, fact_id, chunk_id)``: the facts of each proposition's buckets;
    buckets of equal text share an id and so are merged."""
    return bound.select("entity", "fact_id", "chunk_id").join(texts.select("entity", "prop_id"), "entity")


def asserted(links: DataFrame, bound: DataFrame) -> DataFrame:
    """``(prop_id, entity)``: all entities bound to the facts of a proposition."""
    return links.select("prop_id", "fact_id").distinct().join(bound.select("fact_id", "entity"), "fact_id").select("prop_id", "entity").distinct()


def asserted_together(facts: DataFrame, texts: DataFrame) -> DataFrame | None:
    """``asserted`` from ``facts(chunk_id, idx, entities)``, whose rows hold together what is
    bound to a fact: only distinct pairs are shuffled and no fact is joined. None if two facts
    share an id, which only a join brings together."""
    known = facts.where("chunk_id is not null")
    if not known.groupBy(F.xxhash64("chunk_id", "idx").alias("h")).count().where("count > 1").isEmpty():
        return None
    both = known.select(F.explode("entities").alias("entity"), "entities").select("entity", F.explode("entities").alias("other")).distinct()
    return both.join(texts.select("entity", "prop_id"), "entity").select("prop_id", F.col("other").alias("entity")).distinct()


def proposition_rows(texts: DataFrame, links: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(prop_id, text, entity_ids, fact_ids, chunk_ids)`` with sorted distinct arrays."""
    own = links.groupBy("prop_id").agg(F.array_sort(F.collect_set("fact_id")).alias("fact_ids"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    ents = pairs.groupBy("prop_id").agg(F.array_sort(F.collect_set("entity")).alias("entity_ids"))
    text = texts.groupBy("prop_id").agg(F.min("prop_text").alias("text"))
    return text.join(ents, "prop_id").join(own, "prop_id")


def entity_nodes(mentioned: DataFrame) -> DataFrame:
    """``(id, canonical, text, context)`` of ``(entity, doc_id, ord, pos, chunk_text)``: the
    first surface form and the text of the first chunk that mentions it."""
    rows = mentioned.select(normalize_entity("entity").alias("canonical"), "entity", "doc_id", "ord", "pos", "chunk_text")
    first = rows.groupBy("canonical").agg(F.min_by(F.struct("entity", "chunk_text"), F.struct("doc_id", "ord", "pos")).alias("f"))
    return first.select(F.concat(F.lit("ent::"), "canonical").alias("id"), "canonical", F.col("f.entity").alias("text"), F.col("f.chunk_text").alias("context"))


def heuristic_type(canonical: Column, context: Column) -> Column:
    """A place after in, at or from; a person before is, was or and; else something other."""
    low = F.lower(context)
    place = F.contains(low, F.concat(F.lit("in "), canonical)) | F.contains(low, F.concat(F.lit("at "), canonical)) | F.contains(low, F.concat(F.lit("from "), canonical))
    person = F.contains(low, F.concat(canonical, F.lit(" is "))) | F.contains(low, F.concat(canonical, F.lit(" was "))) | F.contains(low, F.concat(canonical, F.lit(" and ")))
    return F.when(place, "LOCATION").when(person, "PERSON").otherwise("OTHER")


def cached_types(entities: DataFrame, cache: DataFrame, labels: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Entities with an allowed label in ``cache(canonical, label)``, and the others."""
    known = cache.where(F.col("label").isin(*labels)).select("canonical", "label")
    return entities.join(known, "canonical"), entities.join(known, "canonical", "left_anti")


def type_entities(entities: DataFrame, cache: DataFrame, labels: tuple[str, ...], chars: int = 220, classify=heuristic_type) -> DataFrame:
    """``(id, canonical, text, label)``: the cache first, else a classifier on the clipped
    context. One left join; the classifier's cost falls on misses only."""
    known = cache.where(F.col("label").isin(*labels)).select("canonical", F.col("label").alias("cached"))
    rows = entities.join(known, "canonical", "left")
    guess = classify(F.col("canonical"), F.substring("context", 1, chars))
    return rows.select("id", "canonical", "text", F.coalesce("cached", guess).alias("label"))


def type_nodes(typed: DataFrame) -> DataFrame:
    return typed.select(type_id("label").alias("id"), F.upper(strip("label")).alias("text")).distinct()


def support_edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("prop_id").alias("src"), F.col("chunk_id").alias("dst")).distinct().withColumn("edge_type", F.lit("SUPPORTED_BY"))


def type_edges(typed: DataFrame) -> DataFrame:
    return typed.select(F.col("id").alias("src"), type_id("label").alias("dst"), F.lit("IS_A").alias("edge_type"))


def assertion_edges(pairs: DataFrame) -> DataFrame:
    """Both directions between a proposition and its entities."""
    rows = pairs.select("prop_id", entity_id("entity").alias("ent")).distinct()
    out = F.array(F.struct(F.col("prop_id").alias("src"), F.col("ent").alias("dst"), F.lit("ASSERTS").alias("edge_type")), F.struct(F.col("ent").alias("src"), F.col("prop_id").alias("dst"), F.lit("INVOLVED_IN").alias("edge_type")))
    return rows.select(F.explode(out).alias("e")).select("e.*")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("id")
    lost = edges.join(ids, edges.src == ids.id, "left_anti").select("src", "dst", "edge_type", F.lit("src").alias("end"))
    return lost.unionByName(edges.join(ids, edges.dst == ids.id, "left_anti").select("src", "dst", "edge_type", F.lit("dst").alias("end")))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = nodes.groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n")).withColumn("part", F.lit("node"))
    return rows.unionByName(edges.groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")).withColumn("part", F.lit("edge")))


@dataclass
class Graph:
    """A stored graph; ``props`` and ``entities`` hold what nodes have beyond id and text."""

    nodes: DataFrame
    edges: DataFrame

    def of(self, edge_type: str) -> DataFrame:
        return self.edges.where(F.col("edge_type") == edge_type)

    def texts(self, node_type: str) -> DataFrame:
        return self.nodes.where(F.col("node_type") == node_type).select("id", "text")
