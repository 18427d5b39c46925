"""Betweenness with nodes of degree 1 folded into their neighbours."""

import random
from collections import defaultdict

import numpy as np
import pytest

from lodestone.operators import prior
from tests.core.test_graph import brandes


@pytest.mark.parametrize("seed", range(12))
def test_folding_changes_no_value(seed):
    rnd, adj = random.Random(seed), defaultdict(set)
    n = 40
    for _ in range(rnd.choice([20, 35, 60])):
        u, v = rnd.sample(range(n), 2)
        adj[u].add(v), adj[v].add(u)
    own = {v: i for i, v in enumerate(sorted(adj))}
    pairs = np.array([(own[u], own[v]) for u in adj for v in adj[u]])
    n = len(own)
    starts, ends, weight = prior._folded(pairs[:, 0], pairs[:, 1], n, True)
    leaves = sum(len(x) == 1 and len(adj[next(iter(x))]) > 1 for x in adj.values())
    assert (weight == 0).sum() == leaves and weight.sum() == n and leaves > 0
    total, walk = np.zeros(n), prior._sources_per_task(n, starts, ends, weight)
    for s in np.flatnonzero(weight):
        walk(s, total)
    want = brandes(adj)
    assert all(abs(total[own[v]] / ((n - 1) * (n - 2)) - x) < 1e-12 for v, x in want.items())
