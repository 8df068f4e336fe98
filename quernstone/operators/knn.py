"""Nearest neighbours over an adaptive partition of the plane.

The plane is cut into the leaves of a k-d tree whose cuts are medians of a sample, so that leaves hold about the same number of places
whatever their density. Queries visit leaves in the order of their boxes' distance: first the nearest one, then as long as a box is
no further than the k-th neighbour so far; each round visits more. A task has one leaf and a block of the queries that visit it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.scalars import plane_km

from .storage import stored

#: Places sampled for the cuts, leaves at most, and places of a leaf if there are fewer leaves.
SAMPLE, LEAVES, LEAF = 1 << 16, 4096, 64
#: Queries that a task answers for a leaf.
QUERIES = 200_000


class Tree:
    """A balanced k-d tree in arrays: node i has the children 2i and 2i + 1."""

    def __init__(self, xy, depth: int) -> None:
        import numpy as np

        self.depth = depth
        self.axis, self.cut = np.zeros(1 << depth, dtype=np.int64), np.zeros(1 << depth)
        held = {1: xy}
        for node in range(1, 1 << depth):
            own = held.pop(node)
            if len(own):
                self.axis[node] = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                self.cut[node] = np.median(own[:, self.axis[node]])
            right = own[:, self.axis[node]] > self.cut[node]
            held[2 * node], held[2 * node + 1] = own[~right], own[right]

    def leaf(self, xy):
        import numpy as np

        node = np.ones(len(xy), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (xy[np.arange(len(xy)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)


def _leafed(places: DataFrame, tree: Tree) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            xy = np.column_stack([b.column(k).to_numpy() for k in (1, 2)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaf(xy))], ["id", "x", "y", "leaf"])

    return places.select("id", "x", "y").mapInArrow(run, "id long, x double, y double, leaf long")


def _routed(state: DataFrame, boxes: list, step: int) -> DataFrame:
    """(leaf, qid, x, y, r): the next ``step`` leaves of each query that may hold something no further than r."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        at = np.array(boxes, dtype=float)
        leaf, lx, hx, ly, hy = at[:, 0].astype(np.int64), *at[:, 1:].T
        width = max(1, (1 << 21) // len(at))
        for b in batches:
            qid, x, y, r, seen = (b.column(k).to_numpy() for k in range(5))
            for s in range(0, b.num_rows, width):
                p = slice(s, s + width)
                gap = lambda v, lo, hi: np.maximum(0.0, np.maximum(lo[None, :] - v[p, None], v[p, None] - hi[None, :]))  # noqa: B023, E731
                d2 = gap(x, lx, hx) ** 2 + gap(y, ly, hy) ** 2
                order = np.argsort(d2, axis=1, kind="stable")
                place = seen[p, None] + np.arange(step)[None, :]
                at_leaf = np.take_along_axis(order, np.minimum(place, len(at) - 1), axis=1)
                row, col = np.nonzero((place < len(at)) & (np.take_along_axis(d2, at_leaf, axis=1) <= r[p, None]))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (leaf[at_leaf[row, col]], qid[p][row], x[p][row], y[p][row], r[p][row])], ["leaf", "qid", "x", "y", "r"])

    return state.select("qid", "x", "y", "r", "seen").mapInArrow(run, "leaf long, qid long, x double, y double, r double")


def _answered(places: DataFrame, routed: DataFrame, k: int) -> DataFrame:
    """(qid, found): for every visit the k nearest places of the leaf as (d2, dst), none beyond r."""
    visits = {r.leaf: r["count"] for r in routed.groupBy("leaf").count().collect()}  # LEAVES rows at most
    blocks = places.sparkSession.createDataFrame([(leaf, -(-n // QUERIES)) for leaf, n in visits.items()], "leaf long, blocks long")
    side = F.broadcast(blocks)
    asked = routed.join(side, "leaf").select("leaf", F.pmod(F.xxhash64("qid"), F.col("blocks")).alias("block"), F.lit(1).alias("kind"), F.col("qid").alias("id"), "x", "y", "r")
    held = places.join(side, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "id", "x", "y", F.lit(0.0).alias("r"))

    def run(batches: Iterator) -> Iterator:
        """A leaf's places come before its queries."""
        import numpy as np
        import pyarrow as pa

        now, own = None, []
        for b in batches:
            leaf, block, kind, ids, x, y, r = (c.to_numpy() for c in b.columns)
            cut = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *cut], [*cut, len(leaf)], strict=True):
                if s == e:
                    continue
                if (leaf[s], block[s]) != now:
                    now, own = (leaf[s], block[s]), []
                if kind[s] == 0:
                    own.append((ids[s:e], x[s:e], y[s:e]))
                    continue
                if len(own) > 1:
                    own = [tuple(np.concatenate(c) for c in zip(*own, strict=True))]
                pid, px, py = own[0]
                width = max(1, (1 << 20) // len(pid))
                for a in range(s, e, width):
                    q = slice(a, min(a + width, e))
                    dx, dy = x[q, None] - px[None, :], y[q, None] - py[None, :]
                    d2 = dx * dx + dy * dy
                    most = r[q]
                    if len(pid) > k:
                        most = np.minimum(most, np.partition(d2, k - 1, axis=1)[:, k - 1])
                    row, col = np.nonzero(d2 <= most[:, None])
                    order = np.lexsort((pid[col], d2[row, col], row))
                    row, col = row[order], col[order]
                    first = np.searchsorted(row, row)
                    keep = np.arange(len(row)) - first < k
                    row, col = row[keep], col[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q][row]), pa.array(d2[row, col]), pa.array(pid[col])], ["qid", "d2", "dst"])

    rows = held.unionByName(asked).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "kind")
    out = rows.mapInArrow(run, "qid long, d2 double, dst long")
    # a query gets k rows from each leaf of the round at most
    return out.groupBy("qid").agg(F.collect_list(F.struct("d2", "dst")).alias("found"))


def nearest(points: DataFrame, others: DataFrame, k: int, itself: bool = True, metric: str = "plane") -> DataFrame:
    """(src, dst, d2, rank): the k nearest others of each point, ties by id; exact.

    Points have id, x, y. With ``metric`` "km" x is the longitude and y the latitude in degrees, and d2 is in square kilometres on the plane. A place that many
    others share keeps the smallest ids that can be among k; points that share a place are one query. Points without coordinates have no neighbours.
    """
    spark = points.sparkSession
    if metric == "km":
        x, y = plane_km(F.col("y"), F.col("x"))
        points, others = (d.select("id", x.alias("x"), y.alias("y")) for d in (points, others))
    elif metric != "plane":
        raise ValueError('metric is "plane" or "km"')
    kind = dict(points.dtypes)["id"]
    most = k if itself else k + 1
    known = "id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)"
    zero = lambda c: (F.col(c).cast("double") + 0.0).alias(c)  # noqa: E731  -0.0 is 0.0
    clean = lambda d: d.select(F.col("id"), zero("x"), zero("y")).where(known)
    place = Window.partitionBy("x", "y").orderBy("id")
    kept = stored(clean(others).withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= most).drop("_n"))
    n = kept.count()
    if not n:
        return spark.createDataFrame([], f"src {kind}, dst long, d2 double, rank int")
    import numpy as np

    sample = kept.select("x", "y").sample(min(1.0, SAMPLE / n), seed=1).limit(2 * SAMPLE).collect() if n > SAMPLE else kept.select("x", "y").collect()
    depth = max(0, min(LEAVES, n // LEAF).bit_length() - 1)
    leafed = stored(_leafed(kept, Tree(np.array(sample, dtype=float).reshape(-1, 2), depth)))
    boxes = [tuple(r) for r in leafed.groupBy("leaf").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).orderBy("leaf").collect()]  # LEAVES rows at most
    empty = F.array().cast("array<struct<d2:double,dst:bigint>>")
    state = stored(clean(points).select("x", "y").distinct().withColumns({"qid": F.monotonically_increasing_id(), "r": F.lit(float("inf")), "seen": F.lit(0).cast("long"), "best": empty}))
    step = 1
    while True:
        routed = stored(_routed(state, boxes, step))
        if routed.isEmpty():
            break
        new = _answered(leafed, routed, most)
        best = F.slice(F.array_sort(F.concat("best", F.coalesce("found", empty))), 1, most)
        state = state.join(new, "qid", "left").select("qid", "x", "y", best.alias("best"), (F.col("seen") + step).alias("seen"))
        state = stored(state.withColumn("r", F.coalesce(F.try_element_at("best", F.lit(most))["d2"], F.lit(float("inf")))))
        step *= 4
    own = clean(points).withColumnRenamed("id", "src").join(state.select("x", "y", "best"), ["x", "y"])
    rows = own if itself else own.withColumn("best", F.slice(F.filter("best", lambda b: b["dst"] != F.col("src")), 1, k))
    return rows.select("src", F.posexplode("best").alias("rank", "b")).select("src", F.col("b.dst").alias("dst"), F.col("b.d2").alias("d2"), (F.col("rank") + 1).alias("rank"))
