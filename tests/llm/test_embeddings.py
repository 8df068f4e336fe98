from __future__ import annotations

import math

import numpy as np
import pytest

from quernstone.llm.embeddings import MISS, axes, hadamard, hashed, near_duplicates, oracle, rotated, simulated, tables_for
from quernstone.llm.queries import op11_embeddings
from tests.oracle import assert_same


def brute(rows: list[tuple], threshold: float = 0.9) -> dict:
    """vec_id -> (n_links, component_id), over all pairs."""
    good = {i: np.array(v, dtype=float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    top = {i: i for i, _ in rows}
    links = dict.fromkeys(top, 0)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = good[a], good[b]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                top[q] = p
    return {i: (links[i], find(i)) for i in top}


def near(rng, base, cosine: float):
    base = base / np.linalg.norm(base)
    e = rng.normal(size=len(base))
    e -= (e @ base) * base
    return cosine * base + math.sqrt(1 - cosine * cosine) * e / np.linalg.norm(e)


def result(spark, rows, kind: str = "float", **how) -> dict:
    return {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), **how).collect()}


def test_query_equals_sql(spark, sf):
    assert_same(op11_embeddings(spark, sf), oracle(), sf)


def test_transform():
    x = np.random.default_rng(0).normal(size=(5, 16))
    h = np.array([[(-1) ** (i & j).bit_count() for j in range(16)] for i in range(16)]) / 4
    assert np.allclose(hadamard(x), x @ h.T)
    assert np.allclose(np.linalg.norm(rotated(x, 3), axis=1), np.linalg.norm(x, axis=1))
    assert axes(np.array([[0.1, -3.0, 2.0, 0.0]])).tolist() == [[3, 4]]


@pytest.mark.parametrize("n", [1_000, 1_000_000])
@pytest.mark.parametrize("dim", [1, 3, 64, 300])
def test_tables_hold_recall_at_the_threshold(n, dim):
    """2,000 pairs with a cosine of 0.9 just so: share with a common bucket."""
    rng = np.random.default_rng(dim)
    a = rng.normal(size=(2000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = np.array([near(rng, x, 0.9) for x in a]) if dim > 1 else 2 * a
    (sa, ka), (sb, kb) = hashed(a, n, 0.9), hashed(b, n, 0.9)
    met = (ka[:, :, :, None] == kb[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() >= (1 - 3 * MISS if dim > 3 else 0.98)
    assert (np.bitwise_count(sa ^ sb).sum(axis=1) <= simulated(dim, 0.9)[1]).mean() >= 0.995
    assert tables_for(n, dim, 0.9)[1] < 64


@pytest.mark.parametrize("shard", [5, 2048])
def test_groups_equal_brute_force(spark, shard):
    rng = np.random.default_rng(4)
    rows = []
    for size in (1, 2, 5, 40, 90):
        centre = rng.normal(size=24)
        rows += [near(rng, centre, c) for c in rng.uniform(0.93, 1.0, size)]
    chain = [rng.normal(size=24)]
    for _ in range(12):
        chain.append(near(rng, chain[-1], 0.93))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rows + chain + [3 * rows[3], 3 * rows[3], -rows[4], *rng.normal(size=(60, 24))])]
    rows = [(int(i), v) for i, (_, v) in zip(rng.permutation(len(rows)), rows, strict=True)]
    want, got = brute(rows), result(spark, rows, "double", shard=shard)
    assert sum(n for n, _ in want.values()) > 3000
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}


def test_cases(spark):
    rng = np.random.default_rng(6)
    v = [float(x) for x in rng.normal(size=8)]
    w = [float(x) for x in rng.normal(size=8)]
    nan, inf = float("nan"), float("inf")
    rows = [(1, v), (2, v), (3, [2 * x for x in v]), (4, None), (5, []), (6, [0.0] * 8), (7, [None, *v[1:]]), (8, [nan, *v[1:]]), (9, [inf, *v[1:]]), (10, [*v, 0.0]), (11, w), (12, [x * 1e300 for x in w]), (13, [x * 1e-300 for x in w])]
    got = result(spark, rows, "double")
    assert got == brute([(i, [x * 1e-300 for x in e] if i == 12 else [x * 1e300 for x in e] if i == 13 else e) for i, e in rows])
    twice = spark.createDataFrame([(1, v, 3, "x"), (1, v, 3, "x"), (None, v, None, None), (None, w, None, None), (None, None, None, None)], "vec_id long, embedding array<float>, n long, cid string")
    out = sorted(map(tuple, near_duplicates(twice).collect()), key=repr)
    assert out == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, True), (None, 0, None, True)], key=repr)
    assert near_duplicates(twice.limit(0)).count() == 0
    assert near_duplicates(twice).columns == ["vec_id", "n_links", "component_id", "kept"]
