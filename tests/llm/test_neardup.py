"""op9 against all pairs, signatures against their definition, components against union-find."""

import random

import numpy as np
import pytest

from lodestone.llm import neardup, queries
from lodestone.llm.components import connected_components
from tests.conftest import DATA
from tests.oracle import assert_same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(docs, num, den=100):
    sets = {d: shingles(t) for d, t in docs if d is not None}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    return {d: (len(sets[d]), c, d == c) for d, c in roots(ids, links).items()}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table(spark):
    assert_same(spark, "op9", queries.op9_minhash_dedup, queries.oracle_sql()["op9_minhash_dedup"], DATA)


def made(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randrange(300))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rnd.randrange(4, 220))]
        for _ in range(rnd.randrange(1, 9)):  # chains: each copy edits the one before
            docs.append(" ".join(base))
            base = list(base)
            for _ in range(rnd.randrange(0, 4)):
                base[rnd.randrange(len(base))] = word()
    docs += [None, "", " \t\n", "One", "one", "ONE two", "é é é é é é", "  x", "a b c d e", "a b c d e a b c d e"]
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed,num", [(1, 80), (2, 85), (3, 80)])
def test_chains_against_all_pairs(spark, seed, num):
    docs = made(seed)
    df = spark.createDataFrame([(*r, 1, "k") for r in docs], "doc_id long, text string, n int, keys string").repartition(3)
    assert found(neardup.near_duplicates(df, num, 100)) == brute(docs, num)


def test_groups_that_share_much_and_are_apart(spark):
    """Many texts in the same buckets that are not similar enough: the exact way for the rest."""
    rnd = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    docs = []
    for g in range(40):
        own = [f"g{g}x{i}" for i in range(10)]
        for c in range(3):
            tail = own[:-1] + [f"t{g}{c}"]
            docs.append((len(docs), " ".join(common + tail)))
    rnd.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(neardup.near_duplicates(df, 85, 100)) == brute(docs, 85)


def test_rare_pairs_lose_no_link(spark):
    """The exact join for what buckets leave apart, on its own, against all pairs."""
    docs = made(5)
    sets = {d: np.unique([hash(x) & ((1 << 62) - 1) for x in shingles(t)]) for d, t in docs}
    sets = {d: s for d, s in sets.items() if len(s)}
    rows = [(d, len(s), s.astype(np.uint64).tobytes(), *neardup.parity(s.astype(np.uint64)).view(np.int64).tolist()) for d, s in sets.items()]
    table = spark.createDataFrame(rows, "id long, n long, s binary, " + ", ".join(f"{m} long" for m in neardup.PARITY))
    for comps in ({d: d for d in sets}, {d: d % 7 for d in sets}):
        involved = spark.createDataFrame(list(comps.items()), "id long, comp long")
        got = {(r.a, r.b) for r in neardup._rare_pairs(involved, table, 80, 100, lambda df, tag: df).collect()}
        both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
        want = {(a, b) for a in sets for b in sets if a > b and comps[a] != comps[b] and 100 * both(a, b) >= 80 * (len(sets[a]) + len(sets[b]) - both(a, b))}
        assert want <= got and all(comps[a] != comps[b] for a, b in got) and want


def test_repeated_and_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(2, text), (2, text), (1, text), (None, text), (None, None), (3, None)], "doc_id long, text string")
    rows = [(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()]
    assert sorted(rows, key=repr) == sorted([(2, 1, False), (2, 1, False), (1, 1, True), (None, None, True), (None, None, True), (3, 3, True)], key=repr)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_signature_is_the_min_and_max_of_each_permutation():
    s = np.random.default_rng(2).integers(0, 1 << 64, 5000, dtype=np.uint64)
    x = (s >> np.uint64(32)).astype(np.uint32)
    got = neardup.signature(s)
    for i in (0, 50, 95):
        y = x * neardup._A[i] + neardup._B[i]
        assert (got[0, i], got[1, i]) == (y.min(), y.max())


def test_small_sets_share_a_band():
    rng = np.random.default_rng(8)
    for _ in range(6000):
        s = rng.integers(0, 1 << 64, 5, dtype=np.uint64)
        a, b = (neardup.band_keys(neardup.signature(x)) for x in (s, s[:4]))
        assert len(a) == len(b) == 2 * neardup.BANDS and (a == b).any()
    edge = [len(neardup.band_keys(neardup.signature(rng.integers(0, 1 << 64, n, dtype=np.uint64)))) for n in (neardup.SMALL, neardup.SMALL + 1)]
    assert edge == [2 * neardup.BANDS, neardup.BANDS]


def test_signatures_estimate_similarity_without_bias():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(40):
        both, one, two = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for n in (600, 100, 100))
        a, b = neardup.signature(np.concatenate([both, one])), neardup.signature(np.concatenate([both, two]))
        errors.append((a == b).mean() - 600 / 800)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_parities_bound_the_difference():
    rng = np.random.default_rng(6)
    a = np.unique(rng.integers(0, 1 << 64, 400, dtype=np.uint64))
    b = np.concatenate([a[:350], rng.integers(0, 1 << 64, 60, dtype=np.uint64)])
    differ = int(np.bitwise_count(neardup.parity(a) ^ neardup.parity(b)).sum())
    assert 0 < differ <= 50 + 60 and not (neardup.parity(a) ^ neardup.parity(a.copy())).any()


def test_id_filter_lets_all_wanted_through(spark):
    ids = spark.range(0, 30000, 7).withColumnRenamed("id", "doc_id")
    known = neardup.id_filter(ids, "doc_id")
    at = neardup._bits(np.arange(0, 30000), 64 * len(known))
    hit = (known[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    assert hit[::7].all() and hit.mean() < 0.35


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(50)] + [(7, 7), (None, 3), (2000, 1999)]
    rows = {r.id: r.comp for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = roots({x for e in real for x in e}, real)
    assert {k: v for k, v in rows.items() if k in want} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
