"""Intent of a query: how facts combine (topology) and what is asked for (semantic)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOPOLOGIES = ("Sequential", "Parallel")
SEMANTICS = ("HUM", "LOC", "OTHER")
PERSON_CUES = r"(^|[^a-z])(who|whom|whose|he|she|her|his)([^a-z]|$)"
PLACE_CUES = r"(^|[^a-z])(where|in|at|from|near)([^a-z]|$)"
CHAIN_CUES = r"(^|[^a-z])(that|which|whose)([^a-z]|$)"


def heuristic_topology(text: Column) -> Column:
    return F.when(F.lower(text).rlike(CHAIN_CUES), "Sequential").otherwise("Parallel")


def heuristic_semantic(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike(PERSON_CUES), "HUM").when(low.rlike(PLACE_CUES), "LOC").otherwise("OTHER")


def heuristic_intent(queries: DataFrame, text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return queries.withColumn("topology", heuristic_topology(t)).withColumn("semantic", heuristic_semantic(t))


def validated_intent(queries: DataFrame, answer: str) -> DataFrame:
    """Topology and semantic of a model's JSON answer; another value raises an error.

    The topology is matched as it stands, the semantic in upper case."""
    topology = F.get_json_object(answer, "$.topology")
    semantic = F.upper(F.get_json_object(answer, "$.semantic"))
    bad = lambda what, c: F.raise_error(F.concat(F.lit(f"invalid {what}: "), F.coalesce(c, F.lit("none")))).cast("string")
    return queries.withColumn("topology", F.when(topology.isin(*TOPOLOGIES), topology).otherwise(bad("topology", topology))).withColumn(
        "semantic", F.when(semantic.isin(*SEMANTICS), semantic).otherwise(bad("semantic", semantic))
    )
