"""Nearest neighbours: the rows of a brute force, in bounded memory."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd

from sparkloom.operators import vector


def run(q, names, x, own, k, exclude_self, batch=1_000):
    frames = (pd.DataFrame({"v": list(x[i : i + batch]), "vec_id": own[i : i + batch]}) for i in range(0, len(x), batch))
    got = pd.concat(vector._best(SimpleNamespace(value=(q, names)), k, exclude_self)(frames))
    return {n: list(zip(g["vec_id"], g["distance"])) for n, g in got.sort_values(["distance", "vec_id"]).groupby("query_id")}


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_ties_self_and_vectors_without_numbers():
    rng = np.random.default_rng(1)
    x = rng.integers(-1, 2, (5_000, 4)).astype(float)  # many equal distances
    x[x.any(axis=1) == 0] = 1
    own = rng.permutation(5_000)
    for nan, k in ((0, 30), (4_980, 30)):
        rows = x.copy()
        rows[:nan] = np.nan
        q, names = unit(x[-600:]), own[-600:]
        got = run(q, names, rows, own, k, True)
        d = np.round(1 - q @ unit(rows).T, 9) + 0.0
        for i in (0, 1, 599):
            want = sorted((e, o) for e, o in zip(d[i], own) if np.isfinite(e) and o != names[i])[:k]
            assert got[names[i]] == [(o, e) for e, o in want]


def test_memory_does_not_grow_with_queries():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(4_096, 8)), unit(rng.normal(size=(8_000, 8)))
    tracemalloc.start()
    run(q, np.arange(8_000), x, np.arange(4_096), 10, False, 4_096)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6
