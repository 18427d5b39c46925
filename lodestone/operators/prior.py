"""The structural prior on the skeleton of propositions and entities.

Core numbers come from the H-index iteration (Lü, Zhou, Zhang and Stanley 2016). Betweenness
is Brandes' algorithm (2001): where the skeleton is small enough to be proven to fit a
worker, each task walks from its share of the sources over a broadcast adjacency; beyond
that bound blocks of sources are walked level by level with joins. All nodes as sources cost
nodes x edges; where that is too much, a bounded draw of sources gives an unbiased estimate
(Brandes and Pich 2007) at a cost in proportion to the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import minmax
from ..sources.store import discard, materialize, stored_as

#: Directed edges up to which the adjacency is collected and broadcast: 64 MB at most.
BROADCAST_EDGES = 4_000_000
SOURCES_PER_ROUND = 64


def skeleton(edges: DataFrame) -> DataFrame:
    """``(u, v)`` in both directions, distinct, between propositions and entities."""
    pairs = edges.where("edge_type in ('ASSERTS', 'INVOLVED_IN')")
    return pairs.select(F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))).alias("e")).select("e.*").distinct()


def degrees(skel: DataFrame) -> DataFrame:
    return skel.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))


def _fresh_values(edges: DataFrame, values: DataFrame) -> DataFrame:
    """``(id, old, core)``: the H-index of the neighbours' values, at most the old one."""
    near = edges.join(values.withColumnRenamed("id", "v").hint("merge"), "v").groupBy("u", "core").agg(F.count("*").alias("n"))
    more = F.sum("n").over(Window.partitionBy("u").orderBy(F.desc("core")))
    h = near.withColumn("h", F.least("core", more)).groupBy(F.col("u").alias("id")).agg(F.max("h").alias("h"))
    return values.join(h.hint("merge"), "id").selectExpr("id", "core as old", "least(core, h) as core")


def core_numbers(skel: DataFrame) -> DataFrame:
    """``(id, core)``: the H-index of the neighbours' values, from degrees to the fixpoint.

    The neighbours' values are counted per distinct value before anything is ranked, so a
    hub of any degree ranks at most as many rows as there are values. Each round is written
    to the shared folder; the loop stops when no value changes. Values are joined where they
    are: a broadcast would take all of them through the driver in every round.
    """
    edges = materialize(skel, "skeleton")
    table = values = materialize(degrees(edges).selectExpr("id", "degree as core"), "core")
    while True:
        fresh = materialize(_fresh_values(edges, values), "core")
        values = stored_as(fresh.select("id", "core"), fresh)
        discard(table)
        table = fresh
        if fresh.where("old <> core").isEmpty():
            discard(edges)
            return values


def _folded(a: np.ndarray, b: np.ndarray, n: int, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and ends of the edges ``a -> b`` and a weight per node.

    With ``fold`` a node of degree 1 is no node of its own but one more of its neighbour's
    weight: every path to or from it goes through that neighbour. Its weight is 0 then."""
    weight = np.ones(n, np.int64)
    if fold:
        degree = np.bincount(a, minlength=n)
        leaf = (degree[a] == 1) & (degree[b] > 1)
        np.add.at(weight, b[leaf], 1)
        weight[a[leaf]] = 0
        kept = (weight[a] > 0) & (weight[b] > 0)
        a, b = a[kept], b[kept]
    order = np.lexsort((b, a))
    return np.searchsorted(a[order], np.arange(n + 1)), b[order].astype(np.int32), weight


def _sources_per_task(n: int, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray):
    """The dependency sums of one source over an adjacency of offsets and ends; of a node that
    stands for others, too, the pairs among and with these as well."""

    def walk(s: int, total: np.ndarray) -> None:
        dist = np.full(n, -1, np.int32)
        sigma = np.zeros(n)
        dist[s], sigma[s] = 0, 1.0
        levels, frontier, d, reached = [], np.array([s]), 0, 0
        while len(frontier):
            reached += weight[frontier].sum()
            lens = starts[frontier + 1] - starts[frontier]
            tail = np.repeat(frontier, lens)
            head = ends[np.repeat(starts[frontier] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())]
            fresh = np.unique(head[dist[head] < 0])
            dist[fresh] = d + 1
            step = dist[head] == d + 1
            tail, head = tail[step], head[step]
            np.add.at(sigma, head, sigma[tail])
            levels.append((tail, head))
            frontier, d = fresh, d + 1
        delta = np.zeros(n)
        for tail, head in reversed(levels):
            np.add.at(delta, tail, sigma[tail] / sigma[head] * (weight[head] + delta[head]))
        delta[s] = 0
        total += weight[s] * delta
        leaves = weight[s] - 1
        total[s] += leaves * (leaves - 1) + 2 * leaves * (reached - weight[s])

    return walk


def _numbered(nodes: DataFrame) -> DataFrame:
    """Node numbers from 0 in order of ids, by partition offsets: one small row per part."""
    parts = nodes.repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    parts = materialize(parts, "numbered")
    sizes = parts.groupBy("part").agg(F.count("*").alias("c"), F.min("row").alias("low"))
    sizes = sizes.withColumn("before", F.sum("c").over(Window.orderBy("part")) - F.col("c"))  # one row per partition
    return parts.join(sizes, "part").select("id", (F.col("before") + F.col("row") - F.col("low")).alias("no"))


def betweenness(skel: DataFrame, broadcast_edges: int = BROADCAST_EDGES, pivots: int | None = None) -> DataFrame:
    """``(id, betweenness)``, unweighted, without ends, divided by (n-1)(n-2).

    Exact without ``pivots`` and for graphs of at most so many nodes; else that many sources,
    drawn by a hash of their ids, stand for all. A graph of two nodes or fewer has zero
    everywhere."""
    edges = materialize(skel, "skeleton")
    nodes = materialize(_numbered(edges.select(F.col("u").alias("id")).distinct()), "nodes")
    n, m = nodes.count(), edges.count()
    sources, drawn = nodes.select("no", F.col("no").alias("turn")), n
    if pivots is not None and pivots < n:
        rows = nodes.orderBy(F.xxhash64("id"), "id").limit(pivots).select("no").collect()  # at most pivots rows
        drawn = len(rows)
        sources = skel.sparkSession.createDataFrame([(r.no, i) for i, r in enumerate(rows)], "no long, turn long")
    scale = n / max(drawn, 1) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    named = lambda c, k: nodes.select(F.col("id").alias(c), F.col("no").alias(k))
    pairs = edges.join(named("u", "a"), "u").join(named("v", "b"), "v").select("a", "b")
    sums = _local_sums(pairs, sources, n, drawn) if m <= broadcast_edges else _joined_sums(materialize(pairs, "pairs"), sources, drawn)
    return nodes.join(sums, "no", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def _local_sums(pairs: DataFrame, sources: DataFrame, n: int, drawn: int) -> DataFrame:
    """Each task walks from its sources; only called for a proven number of edges."""
    rows = pairs.toArrow()
    a, b = rows.column("a").to_numpy(), rows.column("b").to_numpy()
    starts, ends, weight = _folded(a, b, n, drawn == n)
    core = np.flatnonzero(weight)  # without the folded nodes, numbered anew
    place = np.full(n, -1, np.int32)
    place[core] = np.arange(len(core))
    spark = sources.sparkSession
    shared = spark.sparkContext.broadcast((starts[np.r_[core, n]], place[ends], weight[core], core, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, ends, weight, core, place = shared.value
        total = np.zeros(len(core))
        walk = _sources_per_task(len(core), starts, ends, weight)
        for batch in batches:
            for s in place[batch.column("no").to_numpy()]:
                if s >= 0:
                    walk(s, total)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(core[at]), pa.array(total[at])], names=["no", "b"])

    tasks = max(spark.sparkContext.defaultParallelism, drawn // 2000)
    return sources.select("no").repartition(tasks, "no").mapInArrow(run, "no long, b double").groupBy("no").agg(F.sum("b").alias("b"))


def _joined_sums(pairs: DataFrame, sources: DataFrame, drawn: int) -> DataFrame:
    """Blocks of sources, forward for distances and path counts, backward for dependencies."""
    spark = sources.sparkSession
    out = table = spark.createDataFrame([], "no long, b double")
    for at in range(0, drawn, SOURCES_PER_ROUND):
        own = sources.where((F.col("turn") >= at) & (F.col("turn") < at + SOURCES_PER_ROUND))
        front = materialize(own.select(F.col("no").alias("s"), "no", F.lit(0).alias("d"), F.lit(1.0).alias("sigma")), "front")
        seen, levels = front, [front]
        while True:
            step = front.join(pairs, front.no == pairs.a).groupBy("s", F.col("b").alias("no")).agg(F.sum("sigma").alias("sigma"))
            fresh = step.join(seen.select("s", "no"), ["s", "no"], "left_anti").select("s", "no", F.lit(len(levels)).alias("d"), "sigma")
            front = materialize(fresh, "front")
            if front.isEmpty():
                break
            levels.append(front)
            seen = seen.unionByName(front)
        delta = None
        parts = []
        for lower, upper in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
            far = upper.select("s", F.col("no").alias("b"), F.col("sigma").alias("sb"))
            far = far.withColumn("db", F.lit(0.0)) if delta is None else far.join(delta, ["s", "b"], "left").withColumn("db", F.coalesce("db", F.lit(0.0)))
            near = lower.select("s", F.col("no").alias("a"), F.col("sigma").alias("sa"))
            got = far.join(pairs, "b").join(near, ["s", "a"]).groupBy("s", "a").agg(F.sum(F.col("sa") / F.col("sb") * (1 + F.col("db"))).alias("db"))
            delta = materialize(got.select("s", F.col("a").alias("b"), "db"), "delta")
            parts.append(delta)
        for p in parts:
            out = out.unionByName(p.where("s <> b").select(F.col("b").alias("no"), F.col("db").alias("b")))
        total = materialize(out.groupBy("no").agg(F.sum("b").alias("b")), "sums")
        discard(table, *levels, *parts)
        out = table = total
    return out


def scaled(values: DataFrame, column: str, out: str) -> DataFrame:
    """The column scaled to [0, 1] over all rows; the range is a one-row aggregate."""
    ends = values.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    return values.crossJoin(ends).withColumn(out, minmax(F.col(column).cast("double"), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def structural_prior(skel: DataFrame, alpha_core: float = 0.5, alpha_betw: float = 0.5, pivots: int | None = None) -> DataFrame:
    """``(id, core, betweenness, s_struct)``: the weighted sum of both, scaled."""
    rows = materialize(core_numbers(skel).join(betweenness(skel, pivots=pivots), "id"), "prior")
    rows = scaled(scaled(rows, "core", "c"), "betweenness", "b")
    return rows.select("id", "core", "betweenness", (F.col("c") * alpha_core + F.col("b") * alpha_betw).alias("s_struct"))


def degree_prior(skel: DataFrame) -> DataFrame:
    """A cheap stand-in: scaled degrees, one aggregate over the edges."""
    return scaled(degrees(skel), "degree", "s_struct").select("id", F.round("s_struct", 9).alias("s_struct"))
