"""Intent-controlled expansion from anchors over entities to further propositions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import DIGITS, best
from .walk import propositions_to_entities


def allowed_entities(pairs: DataFrame, intents: DataFrame, edges: DataFrame) -> DataFrame:
    """Of ``pairs(qid, entity, ...)`` those whose type fits the query's intent: HUM wants a
    person, LOC a place, OTHER takes all."""
    is_a = edges.where("edge_type = 'IS_A'").select(F.col("src").alias("entity"), F.col("dst").alias("type"))
    rows = pairs.join(intents.select("qid", "semantic"), "qid").join(is_a, "entity", "left")
    fits = (F.col("semantic") == "OTHER") | ((F.col("semantic") == "HUM") & (F.col("type") == "type::PERSON")) | ((F.col("semantic") == "LOC") & (F.col("type") == "type::LOCATION"))
    return rows.where(fits).drop("semantic", "type")


def allowed(anchored: DataFrame, intents: DataFrame, edges: DataFrame) -> DataFrame:
    """``(qid, id)``: the distinct entities of ``allowed_entities`` of ``candidates``."""
    ents = propositions_to_entities(anchored, edges).withColumnRenamed("id", "entity")
    return allowed_entities(ents, intents, edges).select("qid", F.col("entity").alias("id"))


def candidates(anchored: DataFrame, edges: DataFrame) -> DataFrame:
    """``(qid, anchor, entity)``: the entities that the anchors assert."""
    steps = edges.where("edge_type = 'ASSERTS'").select(F.col("src").alias("anchor"), F.col("dst").alias("entity"))
    return anchored.select("qid", F.col("id").alias("anchor")).join(steps, "anchor").select("qid", "anchor", "entity")


def expanded(lineage: DataFrame, kept: DataFrame, edges: DataFrame) -> DataFrame:
    """``(qid, prop, anchor, entity)``: propositions of the kept entities, with lineage."""
    steps = edges.where("edge_type = 'INVOLVED_IN'").select(F.col("src").alias("entity"), F.col("dst").alias("prop"))
    rows = lineage.join(kept.select("qid", F.col("id").alias("entity")), ["qid", "entity"], "left_semi").join(steps, "entity")
    return rows.select("qid", "prop", "anchor", "entity")


def without_anchors(rows: DataFrame, anchored: DataFrame) -> DataFrame:
    return rows.join(anchored.select("qid", F.col("id").alias("prop")), ["qid", "prop"], "left_anti")


def decayed(rows: DataFrame, anchored: DataFrame, prior: DataFrame, scored: DataFrame, decay: float = 0.8, mix: float = 0.3) -> DataFrame:
    """``(qid, id, final)`` of expanded propositions: a score they have stays, else a mix of
    the prior and the decayed best score of the anchors they come from."""
    lead = rows.join(anchored.select("qid", F.col("id").alias("anchor"), F.col("final").alias("lead")), ["qid", "anchor"])
    most = lead.groupBy("qid", F.col("prop").alias("id")).agg(F.max("lead").alias("lead"))
    return _mixed(most, prior, scored, decay, mix)


def grown(anchored: DataFrame, kept: DataFrame, edges: DataFrame, prior: DataFrame, scored: DataFrame, decay: float = 0.8, mix: float = 0.3) -> DataFrame:
    """``decayed`` of what ``expanded`` makes of the kept entities: each entity takes the best
    score of its anchors along, so the lineage is not written out row by row."""
    own = kept.select("qid", F.col("id").alias("entity"))
    steps = edges.where("edge_type = 'ASSERTS'").select(F.col("src").alias("id"), F.col("dst").alias("entity"))
    led = anchored.select("qid", "id", "final").join(steps, "id").join(own, ["qid", "entity"], "left_semi").groupBy("qid", "entity").agg(F.max("final").alias("lead"))
    more = edges.where("edge_type = 'INVOLVED_IN'").select(F.col("src").alias("entity"), F.col("dst").alias("id"))
    most = led.join(more, "entity").groupBy("qid", "id").agg(F.max("lead").alias("lead"))
    most = most.join(anchored.select("qid", "id"), ["qid", "id"], "left_anti")
    return _mixed(most, prior, scored, decay, mix)


def _mixed(most: DataFrame, prior: DataFrame, scored: DataFrame, decay: float, mix: float) -> DataFrame:
    most = most.join(scored.select("qid", "id", F.col("final").alias("own")), ["qid", "id"], "left").join(prior.select("id", "s_struct"), "id", "left")
    mixed = mix * F.coalesce("s_struct", F.lit(0.0)) + (1 - mix) * (decay * F.col("lead"))
    return most.select("qid", "id", F.round(F.coalesce("own", mixed), DIGITS).alias("final"))


def final_propositions(anchored: DataFrame, more: DataFrame, k: int = 18) -> DataFrame:
    rows = anchored.select("qid", "id", "final").unionByName(more.select("qid", "id", "final"))
    return best(rows.groupBy("qid", "id").agg(F.max("final").alias("final")), k)


def all_scores(scored: DataFrame, grown: DataFrame) -> DataFrame:
    """Every proposition that has a score for a query; one that both hold comes twice, with the
    score it had."""
    return scored.select("qid", "id", "final").unionByName(grown.select("qid", "id", "final"))
