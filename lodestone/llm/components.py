"""Connected components of an edge table, without collecting anything to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, stored_as


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(id, comp)``: each node of an edge and the smallest node it reaches.

    Labels fall to the least label among the neighbours and then to their label's label
    (pointer jumping), until a round changes none. Both joins are plain equi joins of two
    stored tables, which adaptive execution splits where a hub is hot; the minimum is
    pre-aggregated before its shuffle. Null ends and loops count for nothing.
    """
    edges = edges.where("a is not null and b is not null")
    both = materialize(
        edges.selectExpr("a as u", "b as v").unionByName(edges.selectExpr("b as u", "a as v")).distinct(), "edges"
    )
    table = labels = materialize(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).selectExpr("id", "least(id, m) as comp"), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        )
        hooked = materialize(
            labels.join(near, labels.id == near.u).selectExpr("id", "comp as old", "least(comp, near) as comp"), "hook"
        )
        upper = hooked.selectExpr("id as comp", "comp as above")
        jumped = materialize(hooked.join(upper, "comp").selectExpr("id", "old", "above as comp"), "jump")
        labels = stored_as(jumped.select("id", "comp"), jumped)
        discard(table, hooked)
        table = jumped
        if jumped.where("old <> comp").isEmpty():
            discard(both)
            return labels
