"""The two-hop walk from seed chunks; frontiers are ``(qid, id)`` tables.

Questions of a batch reach much the same part of the graph, so a hop does not join each
question's rows: a node holds the questions that reached it as bits, 256 to a row, and an
edge is followed once for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANES = 4
BITS = [f"m{i}" for i in range(LANES)]


def places(queries: DataFrame) -> DataFrame:
    """``queries`` with a place each: ``block``, ``bit`` in it, and the bit in one of ``w0..``."""
    rows = queries.withColumn("no", F.row_number().over(Window.orderBy(*queries.columns)) - 1)
    rows = rows.selectExpr("*", f"cast(no div {64 * LANES} as long) as block", f"cast(no % {64 * LANES} as int) as bit").drop("no")
    return rows.selectExpr("*", *(f"if(bit div 64 = {i}, shiftleft(1L, bit % 64), 0L) as w{i}" for i in range(LANES)))


def packed(nodes: DataFrame, who: DataFrame) -> DataFrame:
    """``(id, block, m0..)`` of ``nodes(qid, id)``: the places of the questions at each node."""
    asked = who.select(F.col("qid").alias("asked"), "block", *(f"w{i}" for i in range(LANES)))
    rows = nodes.select("qid", "id").join(F.broadcast(asked), F.col("qid").eqNullSafe(F.col("asked")))
    return rows.groupBy("id", "block").agg(*(F.bit_or(f"w{i}").alias(m) for i, m in enumerate(BITS)))


def spread(bits: DataFrame) -> DataFrame:
    """Dealt out evenly: the few bytes of a node become rows of up to 256 questions, so that by
    its bytes such a table would be the work of one task or two."""
    return bits.repartition(2 * bits.sparkSession.sparkContext.defaultParallelism)


def unpacked(bits: DataFrame, who: DataFrame) -> DataFrame:
    """One row per node and question, with all columns of both but the bits."""
    asked = who.withColumnRenamed("block", "asked")
    held = F.expr("(" + " | ".join(f"(m{i} & w{i})" for i in range(LANES)) + ") <> 0")
    own = [f"w{i}" for i in range(LANES)]
    return bits.join(F.broadcast(asked), (F.col("block") == F.col("asked")) & held).drop("asked", "block", *BITS, *own)


def bit_counts(rows: DataFrame, who: DataFrame, by: str, name: str) -> DataFrame:
    """``(qid, by, name)``: how many of the rows ``(by, block, m0..)`` hold each question."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            held = np.ascontiguousarray(np.stack([b.column(m).to_numpy() for m in BITS], axis=1))
            kinds = b.column(by).dictionary_encode()
            code, block = kinds.indices.to_numpy(zero_copy_only=False), b.column("block").to_numpy()
            for c, k in {*zip(code.tolist(), block.tolist(), strict=True)}:
                own = np.unpackbits(held[(code == c) & (block == k)].view(np.uint8), axis=1, bitorder="little")
                key = kinds.dictionary[c].as_py(), k
                total[key] = total.get(key, 0) + own.sum(axis=0, dtype=np.int64)
        for (kind, k), n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([kind] * len(at), pa.string()), pa.array(np.full(len(at), k)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=[by, "block", "bit", name])

    sums = rows.select(by, "block", *BITS).mapInArrow(run, f"{by} string, block long, bit int, {name} long")
    sums = sums.groupBy(by, "block", "bit").agg(F.sum(name).alias(name))
    return sums.join(F.broadcast(who.select("qid", "block", "bit")), ["block", "bit"]).select("qid", by, name)


def seed_chunks(ranked: DataFrame, chunks: DataFrame, chunk_nodes: DataFrame) -> DataFrame:
    """``(qid, id)``: the chunks of ranked documents that are nodes of the graph, distinct."""
    rows = ranked.select("qid", "doc_id").join(chunks.select("doc_id", F.col("chunk_id").alias("id")), "doc_id").select("qid", "id").distinct()
    return rows.join(chunk_nodes.select("id"), "id", "left_semi").select("qid", "id")


def _hop(frontier: DataFrame, edges: DataFrame, edge_type: str, start: str, end: str, more: DataFrame | None = None) -> DataFrame:
    """The ends of the frontier's edges, together with the rows of ``more``."""
    steps = edges.where(F.col("edge_type") == edge_type).select(F.col(start).alias("id"), F.col(end).alias("to"))
    asked = frontier.select("qid") if more is None else frontier.select("qid").unionByName(more.select("qid"))
    who = places(asked.distinct())
    got = packed(frontier, who).join(steps, "id").select(F.col("to").alias("id"), "block", *BITS)
    if more is not None:
        got = got.unionByName(packed(more, who))
    return unpacked(spread(got.groupBy("id", "block").agg(*(F.bit_or(m).alias(m) for m in BITS))), who).select("qid", "id")


def chunks_to_propositions(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    return _hop(seeds, edges, "SUPPORTED_BY", "dst", "src")


def propositions_to_entities(props: DataFrame, edges: DataFrame) -> DataFrame:
    return _hop(props, edges, "ASSERTS", "src", "dst")


def entities_to_propositions(ents: DataFrame, edges: DataFrame, first: DataFrame) -> DataFrame:
    """Propositions of the entities, together with those of the first hop."""
    return _hop(ents, edges, "INVOLVED_IN", "src", "dst", first)


def walk(seeds: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """First-hop propositions, their entities, and all propositions reached."""
    first = chunks_to_propositions(seeds, edges)
    ents = propositions_to_entities(first, edges)
    return first, ents, entities_to_propositions(ents, edges, first)


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All edges whose two ends are among a query's ``nodes(qid, id)``."""
    left = nodes.select("qid", F.col("id").alias("src")).distinct()
    right = nodes.select("qid", F.col("id").alias("dst")).distinct()
    return edges.join(left, "src").join(right, ["qid", "dst"], "left_semi").select("qid", "src", "dst", "edge_type")


def induced_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(qid, edge_type, n_edges)`` of ``induced``: the ends' bits meet on the edge and are
    counted there, so no edge is written once per question."""
    who = places(nodes.select("qid").distinct())
    bits = packed(nodes, who)
    left = bits.select(F.col("id").alias("src"), "block", *BITS)
    right = bits.select(F.col("id").alias("dst"), "block", *(F.col(m).alias(f"w{i}") for i, m in enumerate(BITS)))
    both = edges.join(left, "src").join(right, ["dst", "block"]).selectExpr("edge_type", "block", *(f"m{i} & w{i} as m{i}" for i in range(LANES)))
    return bit_counts(both.where(" or ".join(f"{m} <> 0" for m in BITS)), who, "edge_type", "n_edges").where("qid is not null")


def subgraph_sizes(seeds: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(qid, n_seed_chunks, n_q_nodes, n_q_edges)`` of the seeds and of all ``nodes(qid, id)``
    of each query's subgraph."""
    who = places(nodes.select("qid").distinct())
    n_nodes = bit_counts(packed(nodes, who).withColumn("part", F.lit("node")), who, "part", "n_q_nodes").select("qid", "n_q_nodes")
    n_edges = induced_counts(nodes, edges).groupBy("qid").agg(F.sum("n_edges").alias("n_q_edges"))
    rows = seeds.groupBy("qid").agg(F.count("*").alias("n_seed_chunks")).join(n_nodes, "qid").join(n_edges, "qid", "left")
    return rows.withColumn("n_q_edges", F.coalesce("n_q_edges", F.lit(0)))
