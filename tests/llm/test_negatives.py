from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm.negatives import Index, hard_negatives, oracle
from quernstone.llm.queries import op12_hard_negatives
from tests.oracle import assert_same

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows: list[tuple], every: int, count: int = 5, most: int = 3) -> list[tuple]:
    """All pairs in plain integers."""
    good = {(i, y, tuple(math.floor(256 * x) for x in v)) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, y, a in good:
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a, b, strict=False)), j, z == y) for j, z, b in good if j != i)
        for s, j, _ in [x for x in scored if x[2]][:count]:
            fits = [(-t, k) for t, k, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, r, k, -s, t) for r, (t, k) in enumerate(fits[:most], 1)]
    return sorted(out)


def test_query_equals_sql(spark, sf):
    assert_same(op12_hard_negatives(spark, sf), oracle(), sf)


@pytest.mark.parametrize("width", [1, 7, 30])
def test_index_finds_all_pairs(width):
    rng = np.random.default_rng(width)
    rows = np.floor(rng.normal(size=(400, width)) * 50 * (rng.random((400, width)) < 0.4))
    anchors = np.floor(rng.normal(size=(30, width)) * 50)
    index = Index(rows)
    scores = anchors @ rows.T
    for share in (0.99, 0.9, 0.5, 0.05):
        least = np.quantile(scores, share, axis=1)
        i, j, s = index.pairs(anchors, least)
        assert set(zip(i.tolist(), j.tolist(), s.tolist(), strict=True)) == {(x, y, scores[x, y]) for x, y in zip(*np.nonzero(scores >= least[:, None]), strict=True)}
    i, _, _ = index.pairs(anchors, np.full(30, -np.inf))
    assert len(i) == scores.size


def test_equals_brute_force_with_ties_groups_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 12))
    rows = []
    for i in range(400):
        v = rng.integers(-2, 3, size=12) / 4 if i % 3 == 0 else centres[rng.integers(8)] * 0.4 + rng.normal(size=12) * 0.15
        rows.append((i, [float(x) for x in v], int(rng.integers(4)) if i % 5 else 1))
    rows += rows[:40] + [(9, [0.5] * 12, 2), (1000, rows[7][1], 3), (1001, rows[7][1][:5], 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 20)
    assert len(want) > 100
    assert sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 20 == 0).collect())) == want
    monkeypatch.setattr("quernstone.llm.negatives.ANCHOR_BYTES", 700)
    monkeypatch.setattr("quernstone.llm.negatives.ROWS", 50)
    monkeypatch.setattr("quernstone.llm.negatives.POOL", 10)
    assert sorted(map(tuple, hard_negatives(df.where("vec_id < 120"), F.col("vec_id") % 20 == 0).collect())) == brute([r for r in rows if r[0] < 120], 20)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    base = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 5.0], 2), (3, [0.9, -5.0], 2), (4, [0.96, 0.0], 2), (5, [0.4, 0.0], 2), (6, [0.6], 3), (7, [0.6, 1.0, 2.0], 3)]
    odd = [(8, None, 1), (9, [], 1), (10, [None, 1.0], 1), (11, [nan, 1.0], 1), (12, [inf, 1.0], 1), (13, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (20, [0.0, 0.0], 5), (40, [-1.0, -1.0], 6), (60, [2.0, 0.0], 7)]
    rows = base + odd
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA + ", norm int, rank int")
    got = sorted(map(tuple, hard_negatives(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == brute(rows, 20) and got
    assert hard_negatives(df, F.col("vec_id") % 20 == 0).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    huge = [(i, [1e7 + i, 3.0], i % 2) for i in range(6)]
    assert sorted(map(tuple, hard_negatives(spark.createDataFrame(huge, SCHEMA), F.col("vec_id") == 0, low=50, high=100).collect())) == sorted(
        (0, j, r, k, s, t) for j in (2, 4) for s in [_dot(huge[0][1], huge[j][1])] for r, (t, k) in enumerate(sorted(((_dot(huge[0][1], huge[n][1]), n) for n in (1, 3, 5) if _dot(huge[0][1], huge[n][1]) <= s), reverse=True)[:3], 1)
    )
    assert hard_negatives(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def _dot(a, b):
    return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b, strict=True))
