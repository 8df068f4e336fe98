from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import graph, knn, panel

def frame(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")


def brute_nearest(xy, others, k, itself):
    d = (xy[:, None, 0] - others[None, :, 0]) ** 2 + (xy[:, None, 1] - others[None, :, 1]) ** 2
    if not itself:
        np.fill_diagonal(d, np.inf)
    m = min(k, len(others) - (not itself))
    return {i: np.lexsort((np.arange(len(others)), d[i]))[:m].tolist() for i in range(len(xy))}


def found(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.src, r.rank)):
        got.setdefault(r.src, []).append(r.dst)
        assert r.rank == len(got[r.src])
    return got


@pytest.mark.parametrize("k", [1, 5])
def test_nearest_on_clusters_copies_and_outliers(spark, k, monkeypatch):
    monkeypatch.setattr(knn, "LEAF", 8)
    monkeypatch.setattr(knn, "QUERIES", 40)
    rng = np.random.default_rng(k)
    xy = np.concatenate([rng.normal(0, 1e-4, (300, 2)), rng.normal(50, 3, (200, 2)), np.repeat([[7.0, 7.0]], 60, axis=0), rng.integers(0, 4, (80, 2)), [[1e6, -1e6], [0, 9e5]]])
    xy = xy[rng.permutation(len(xy))]
    p = frame(spark, xy)
    assert found(graph.nearest(p, p, k, itself=False)) == brute_nearest(xy, xy, k, False)
    some = frame(spark, xy[:9])
    assert found(graph.nearest(p, some, k)) == brute_nearest(xy, xy[:9], k, True)


def test_nearest_without_coordinates_and_others(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 3.0, 4.0), (5, -0.0, 0.0)], "id long, x double, y double")
    assert found(graph.nearest(p, p, 9, itself=False)) == {1: [5, 4], 4: [1, 5], 5: [1, 4]}
    assert graph.nearest(p, p.limit(0), 2).count() == 0 and graph.nearest(p.limit(0), p, 2).count() == 0
    with pytest.raises(ValueError):
        graph.nearest(p, p, 1, metric="miles")
    km = graph.nearest(p.where("id in (1, 4)"), p.where("id = 4"), 1, metric="km").where("src = 1").first()
    assert km.d2 == pytest.approx((3 * 111 * np.cos(np.radians(4))) ** 2 + 444**2)


def test_nearest_work_is_bounded(spark):
    """A hundred thousand points at one place and a cloud: no leaf is large, and a query visits few leaves."""
    n = 100_000
    p = spark.range(n).select("id", F.when(F.col("id") % 10 < 9, 1.0).otherwise(F.rand(3)).alias("x"), F.when(F.col("id") % 10 < 9, 1.0).otherwise(F.rand(4)).alias("y"))
    p = graph.checkpoint(p)
    out = graph.checkpoint(graph.nearest(p, p, 5, itself=False))
    assert out.count() == 5 * n
    assert {r.dst for r in out.where("src = 77").collect()} <= set(range(9)) and out.where("src = 77 and d2 = 0").count() == 5


def brute_dbscan(xy, eps, least):
    d2 = (xy[:, None, 0] - xy[None, :, 0]) * (xy[:, None, 0] - xy[None, :, 0]) + (xy[:, None, 1] - xy[None, :, 1]) * (xy[:, None, 1] - xy[None, :, 1])
    near = d2 <= eps * eps
    core = near.sum(axis=1) >= least
    label = np.where(core, np.arange(len(xy)), len(xy))
    while True:
        new = label.copy()
        for i in np.flatnonzero(core):
            new[i] = label[near[i] & core].min()
        if (new == label).all():
            break
        label = new
    names = {v: k for k, v in enumerate(sorted(set(label[core])))}
    own = {i: names[label[i]] for i in np.flatnonzero(core)}
    return {i: (bool(core[i]), own[i] if core[i] else min([own[j] for j in np.flatnonzero(near[i] & core)], default=-1)) for i in range(len(xy))}


@pytest.mark.parametrize(("eps", "least"), [(0.2, 5), (0.1, 3), (0.5, 12)])
def test_dbscan_equals_brute_force(spark, eps, least):
    rng = np.random.default_rng(least)
    xy = np.concatenate([rng.normal(0, 0.25, (150, 2)), rng.uniform(-3, 3, (150, 2)), rng.integers(-3, 3, (60, 2)) * 0.1, np.repeat([[2.0, 2.0]], 7, axis=0)])
    got = {r.id: (r.core, r.cluster) for r in graph.dbscan(frame(spark, xy), eps, least).collect()}
    assert got == brute_dbscan(xy, eps, least)
    assert {r.id for r in graph.core_points(frame(spark, xy), eps, least).collect()} == {i for i, (core, _) in got.items() if core}


def test_crowded_cells_are_linked_by_a_near_pair_only(spark):
    """Two crowds whose nearest points are just within eps, and two just beyond it."""
    rng = np.random.default_rng(5)
    for gap, clusters in ((0.9999, {0}), (1.0001, {0, 1})):
        left = np.column_stack([-rng.random(2000) * 0.3, rng.random(2000) * 0.3])
        right = np.column_stack([gap + rng.random(2000) * 0.3, rng.random(2000) * 0.3])
        left[0], right[0] = (0, 0.15), (gap, 0.15)
        got = graph.dbscan(frame(spark, np.concatenate([left, right])), 1.0, 5)
        assert {r.cluster for r in got.select("cluster").distinct().collect()} == clusters


def test_dense_cell_ends_without_pairs(spark):
    p = graph.checkpoint(spark.range(100_000).select("id", (F.rand(1) * 0.5).alias("x"), (F.rand(2) * 0.5).alias("y")).unionByName(spark.createDataFrame([(200_000, 1.2, 0.25), (200_001, 9.0, 9.0), (200_002, None, 1.0)], "id long, x double, y double")))
    got = graph.dbscan(p, 1.0, 5)
    assert {(r.core, r.cluster): r["count"] for r in got.groupBy("core", "cluster").count().collect()} == {(True, 0): 100_001, (False, -1): 2}
    with pytest.raises(ValueError):
        graph.dbscan(p, 0.0)


def test_ranks_and_quantile_of_a_hot_value(spark):
    rows = graph.checkpoint(spark.range(50_000).select("id", F.when(F.col("id") % 10 < 9, 7.0).when(F.col("id") % 100 == 99, None).otherwise(F.col("id").cast("double")).alias("v")))
    places = graph.places(rows, "v")
    assert places.where("v = 7").first().n == 45_000
    got = panel.ranks(rows, "v")
    assert got.count() == 50_000 and got.where("v is null and rank is null").count() == 500
    hot = got.where("v = 7").select("rank", "dense_rank", "mean_rank").distinct().collect()
    assert [tuple(r) for r in hot] == [(1, 1, 22_500.5)]
    values = np.array([7.0] * 45_000 + [float(i) for i in range(9, 50_000, 10) if i % 100 != 99])
    for p in (0.0, 0.3, 0.75, 0.95, 1.0):
        assert graph.quantile(rows, "v", p).first().cut == pytest.approx(float(np.quantile(values, p)))


def test_ordinal_cuts_a_hot_value(spark):
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id")).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = graph._ranged(rows, ["v"])
        sizes = [r["count"] for r in ranged.groupBy("_part").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 15_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = graph.ordinal(rows, ["v"]).orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(40_000)) and [r.v for r in got] == sorted(r.v for r in got)
