"""MinHash near-duplicate detection with minimum and maximum of every permutation.

One permutation of the shingle hashes gives two signature values, its minimum and its
maximum over the set, so a signature of 192 values costs 96 evaluations per shingle. Six
values (three permutations) make a band and 32 bands give the candidates: a pair of
similarity 0.85 is missed with probability 3e-7, one of 0.80 with 6e-5 where sets are large.
Minimum and maximum are never one shingle, so small sets agree less often; those of at most
``SMALL`` shingles get twice the bands, which leaves 2e-7 for 4 of 5 shared shingles.
Candidates are confirmed on the full shingle sets.

No bucket is ever expanded into all its pairs. Equal sets become one class. A bucket links
its members to its smallest one; members that this leaves in other components are compared
with one more member per bucket. The texts of buckets that are then still apart go through
an exact similarity join on their rarest shingles. Pairs whose sizes or 1024-bit parities
rule the similarity out are dropped before their sets are fetched. So every pair that shares
a band is either confirmed, refuted or already inside one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import discard, materialize
from .components import connected_components

K, BANDS, PERMUTATIONS, SMALL = 5, 32, 3, 32
_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 32, 2 * BANDS * PERMUTATIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _rng.integers(0, 1 << 32, 2 * BANDS * PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]
_SALT = tk.mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64))
_CHUNK = 2048


def signature(s: np.ndarray) -> np.ndarray:
    """The min and the max of every permutation over a non-empty set, 2 x (bands * 3)."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    n = BANDS * PERMUTATIONS * (2 if len(s) <= SMALL else 1)
    low = high = None
    for at in range(0, len(x), _CHUNK):
        y = x[at : at + _CHUNK] * _A[:n]
        y += _B[:n]
        lo, hi = y.min(axis=1), y.max(axis=1)
        low = lo if low is None else np.minimum(low, lo)
        high = hi if high is None else np.maximum(high, hi)
    return np.stack([low, high])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is mixed in, so keys of bands differ."""
    bands = sig.shape[1] // PERMUTATIONS
    v = sig.reshape(2, bands, PERMUTATIONS).transpose(1, 0, 2).reshape(bands, -1).astype(np.uint64)
    h = _SALT[:bands].copy()
    for j in range(v.shape[1]):
        h = tk.mix((h ^ v[:, j]) * np.uint64(0x9E3779B97F4A7C15))
    return h.view(np.int64)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    data, offsets = tk.utf8(batch.column("text"))
    h, _, _, at = tk.words(data, offsets, tk.SPACED)
    for i in range(batch.num_rows):
        yield tk.shingles(h[at[i] : at[i + 1]], k)


def signatures(docs: DataFrame, k: int = K) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fa, fb, n, keys)``: a 128-bit fingerprint of the
    shingle set, its size and the band keys (empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in tk.parts(whole)):
            fa, fb, n, keys = [], [], [], []
            for s in _sets(b, k):
                n.append(len(s))
                ranks = np.arange(1, len(s) + 1, dtype=np.uint64) | np.uint64(1)
                fa.append(int(tk.mix(np.add.reduce(tk.mix(s), keepdims=True) + np.uint64(len(s)))[0]))
                fb.append(int(tk.mix(np.bitwise_xor.reduce(tk.mix(s * ranks), keepdims=True) + np.uint64(len(s)))[0]))
                keys.append(band_keys(signature(s)) if len(s) else np.zeros(0, np.int64))
            lens = np.array([0, *map(len, keys)]).cumsum()
            yield pa.record_batch(
                [
                    b.column("doc_id"),
                    pa.array(np.array(fa, np.uint64).view(np.int64)),
                    pa.array(np.array(fb, np.uint64).view(np.int64)),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]))),
                ],
                names=["doc_id", "fa", "fb", "n", "keys"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fa long, fb long, n long, keys array<long>")


PARITY = tuple(f"p{i}" for i in range(16))
#: Most bits of the filter that tells which documents' sets are wanted: 16 MB.
FILTER_BITS = 1 << 27


def parity(s: np.ndarray) -> np.ndarray:
    """1024 bits, each telling whether an odd number of the set's hashes fall on it. Two sets
    differ in at least as many elements as their parities differ in bits."""
    odd = np.bincount((s & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    return (tk.mix(ids.view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bit set of bounded size in which the bit of every id is set; it is 16 times as large
    as the ids are many, up to ``FILTER_BITS``. Beyond, it only lets more others through."""
    n = ids.count()
    size = 1 << 16
    while size < min(16 * n, FILTER_BITS):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size // 64, np.uint64)
        for b in batches:
            at = _bits(b.column(0).to_numpy(), size)
            np.bitwise_or.at(own, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        words = np.flatnonzero(own)
        yield pa.record_batch([pa.array(words), pa.array(own[words].view(np.int64))], names=["word", "bits"])

    rows = ids.select(column).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _set_rows(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``(id, n, s, p0, ...)``: sets of all wanted ids and of few others. The texts stay where
    they are read; only the filter goes to them."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in (part for whole in batches for part in tk.parts(whole)):
            at = _bits(b.column("doc_id").to_numpy(), 64 * len(known))
            b = b.filter(pa.array((known[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            if not b.num_rows:
                continue
            sets = list(_sets(b, k))
            marks = np.stack([parity(s) for s in sets]).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), *(pa.array(m) for m in marks.T)], names=["id", "n", "s", *PARITY])

    fields = "id long, n long, s binary, " + ", ".join(f"{m} long" for m in PARITY)
    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, fields)


def _close(num: int, den: int, a: str, b: str) -> Column:
    """Whether two sets' sizes ``an`` and ``bn`` and parities leave the similarity possible:
    of an + bn elements at most (den - num) / (den + num) may be in one set only."""
    differ = sum((F.bit_count(F.col(f"{a}{m}").bitwiseXOR(F.col(f"{b}{m}"))) for m in PARITY), F.lit(0))
    x, y = F.col(f"{a}n"), F.col(f"{b}n")
    return (F.least(x, y) * den >= F.greatest(x, y) * num) & (differ * (den + num) <= (x + y) * (den - num))


def _possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` that sizes and parities do not rule out.

    Pairs are written before and after, so that no aggregation shares an exchange with the
    joins and adaptive execution can split a hub with very many pairs.
    """
    pairs = materialize(pairs.distinct(), "pairs")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"{c}n"), *(F.col(m).alias(f"{c}{m}") for m in PARITY))
    found = pairs.join(side("a"), "a").join(side("b"), "b").where(_close(num, den, "a", "b")).select("a", "b")
    found = materialize(found, "possible")
    discard(pairs)
    return found


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets have den * |A & B| >= num * |A | B|.

    Each pair carries one set to the other's row; both joins are of direct exchanges, so a
    hub with very many pairs can be split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.selectExpr("id as a", "s as sa")
    right = sets.selectExpr("id as b", "s as sb")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _rare_pairs(involved: DataFrame, sets: DataFrame, num: int, den: int, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Pairs ``(a, b)`` of ``involved(id, comp)`` that are in different components and share
    one of their rarest shingles.

    A set of n shingles shares at least ceil(n * num / den) of them with one that is similar
    enough. Hence if each set's shingles are taken in one order for all, rarest first, its
    first n - ceil(n * num / den) + 1 hold a shared one (a prefix filter), and the places of
    the first shared one leave room for enough others (a positional filter). A passage that
    very many texts hold is in no prefix of those that have enough else, so no pairs are made
    of it, whatever bucket the texts meet in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in tk.parts(whole, "s")):
            own = [np.frombuffer(s.as_buffer(), np.int64) for s in b.column("s")]
            yield pa.record_batch([pa.array(np.concatenate(own)), pa.array(np.repeat(b.column("id").to_numpy(), [len(x) for x in own]))], names=["sh", "id"])

    rows = store(involved.join(sets.select("id", "n", "s", *PARITY), "id").dropDuplicates(["id"]), "involved")
    tokens = store(rows.select("id", "s").mapInArrow(run, "sh long, id long"), "tokens")
    common = tokens.groupBy("sh").agg(F.count("*").alias("c")).where("c > 1")
    # shingles of one set only come first in the order and find nothing: they are only counted
    shared = tokens.join(common, "sh").join(rows.select("id", "n"), "id")
    own = Window.partitionBy("id")
    shared = shared.withColumn("place", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "sh")))
    first = shared.where(f"place <= n - (n * {num} + {den - 1}) div {den} + 1").select("sh", "id", "place")
    first = store(store(first, "first").join(rows.drop("s"), "id"), "first")
    parts = first.groupBy("sh", "comp").agg(F.count("*").alias("c"))
    tops = parts.groupBy("sh").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp"))["comp"].alias("top")).where("comps > 1")
    rest = store(first.join(tops, "sh").where("comp <> top").drop("comps", "top"), "rest")
    left, right = (df.select("sh", *(F.col(x).alias(c + x) for x in df.columns if x != "sh")) for c, df in (("a", rest), ("b", first)))
    # of the first shingle that two sets share, what follows in both bounds all they share
    follow = F.least(F.col("an") - F.col("aplace"), F.col("bn") - F.col("bplace")) + 1
    near = (follow * (num + den) >= (F.col("an") + F.col("bn")) * num) & _close(num, den, "a", "b")
    found = left.join(right, "sh").where((F.col("acomp") != F.col("bcomp")) & near)
    return found.selectExpr("greatest(aid, bid) as a", "least(aid, bid) as b")


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100, k: int = K) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs(doc_id, text, ...)``.

    Words are what white space (0x20, 0x09-0x0D) separates after A-Z were lower-cased. A
    document's set holds its distinct k-word shingles, or the whole word sequence where that
    is shorter. Documents are linked if intersection / union >= num / den.

    A null or empty text, or one without words, has an empty set, is linked with nothing and
    kept. Rows that repeat a doc_id are one document. A row whose doc_id is null is linked
    with nothing, gets a null component and is kept. Further columns are ignored; an empty
    table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made: list[DataFrame] = []  # what the result does not read

    def store(df: DataFrame, tag: str) -> DataFrame:
        made.append(materialize(df, tag))
        return made[-1]

    sig = materialize(signatures(docs, k), "sig")
    classes = (
        sig.where("n > 0 and doc_id is not null").groupBy("fa", "fb").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    )
    classes = store(classes, "classes")
    rows = classes.select(F.explode("keys").alias("key"), "id", "n")
    hubs = rows.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("h")).where("c > 1")
    hubs = store(hubs.selectExpr("key", "h.id as hub", "h.n as hub_n"), "hubs")
    members = store(rows.join(hubs, "key"), "members")
    fits = lambda x, y: F.least(x, y) * den >= F.greatest(x, y) * num
    pairs = members.where((F.col("id") != F.col("hub")) & fits(F.col("n"), F.col("hub_n"))).selectExpr("id as a", "hub as b")
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    sets = store(_set_rows(docs, wanted, k), "sets")
    links = store(_confirm(_possible(pairs, sets, num, den), sets, num, den), "links")
    labels = connected_components(links)
    for last in (False, True):
        here = members.select("key", "id", "n").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        here = store(here, "here")
        parts = here.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("id", "key").alias("h"), "id", "n")).alias("other"))
        apart = parts.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp", "other")).alias("top")).where("comps > 1")
        apart = store(apart.selectExpr("key", "top.comp as top", "top.other.id as other", "top.other.n as other_n"), "apart")
        if apart.isEmpty():
            break
        if last:
            involved = here.join(apart, "key", "left_semi").select("id", "comp").distinct()
            found = store(_rare_pairs(involved, sets, num, den, store).distinct(), "rare")
        else:
            rest = here.join(apart, "key").where("comp <> top").where(fits(F.col("n"), F.col("other_n")))
            found = _possible(rest.selectExpr("id as a", "other as b"), sets, num, den)
        fresh = store(_confirm(found, sets, num, den), "links")
        if fresh.isEmpty():
            continue
        up = lambda c: labels.selectExpr(f"id as {c}", f"comp as {c}c")
        lifted = fresh.join(up("a"), "a", "left").join(up("b"), "b", "left").selectExpr("a as id_a", "b as id_b", "coalesce(ac, a) as a", "coalesce(bc, b) as b")
        lifted = store(lifted, "lifted")
        roots = connected_components(lifted.select("a", "b"))
        every = labels.unionByName(lifted.selectExpr("id_a as id", "a as comp")).unionByName(lifted.selectExpr("id_b as id", "b as comp")).distinct()
        roots = roots.selectExpr("id as comp", "comp as root")
        labels = store(every.join(roots, "comp", "left").selectExpr("id", "coalesce(root, comp) as comp"), "labels")
    final = classes.select("fa", "fb", "id").join(labels, "id", "left").selectExpr("fa", "fb", "coalesce(comp, id) as comp")
    final = materialize(final, "final")
    discard(*made)
    with_set = sig.where("n > 0 and doc_id is not null").select("doc_id", "n", "fa", "fb").join(final, ["fa", "fb"])
    bare = sig.where("n = 0 or doc_id is null").selectExpr("doc_id", "n", "doc_id as comp")
    return with_set.select("doc_id", "n", "comp").unionByName(bare).selectExpr(
        "doc_id", "n as n_shingles", "comp as component_id", "coalesce(doc_id = comp, true) as kept"
    )
