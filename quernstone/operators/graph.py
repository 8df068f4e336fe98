"""Neighbourhoods and components over points, as joins on grid cells; no dense matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .knn import nearest
from .storage import shared_folder, stored  # noqa: F401


checkpoint = stored
#: Cuts of a cell into quarters; what is left then are points that doubles hardly tell apart.
DEEPEST = 45


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """``df`` stored in a global order, with the number of its part and its place in the part's file.

    A hash of the whole row comes last in the order, so that rows of one hot value are cut over several parts.
    """
    spread = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if not kind.startswith("map")])
    keys = [*order, spread]
    return stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))


def ordinal(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``ordinal`` from 0 in a global order: range partitions, counts per partition, offsets; no task sees all rows.

    The session's number of shuffle partitions holds, so parallelism follows the size of the cluster.
    """
    ranged = _ranged(df, order)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # a row per partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranged.join(F.broadcast(before), "_part").withColumn("ordinal", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def places(df: DataFrame, measure: str) -> DataFrame:
    """(v, n, before, dense): every value but null with its rows, the rows of smaller values, and the number of smaller values.

    Rows are counted by value before anything is sorted, so a value of most rows is one row of the prefix sums.
    """
    counts = df.where(F.col(measure).isNotNull()).groupBy(F.col(measure).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = _ranged(counts, ["v"])
    sums = ranged.groupBy("_part").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_k"))
    # a row per partition
    back = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *[F.coalesce(F.sum(c).over(back), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_k")])
    within_part = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(offsets), "_part")
    return out.select("v", "n", *[(F.coalesce(F.sum(x).over(within_part), F.lit(0)) + F.col(f"{c}_before")).alias(name) for x, c, name in (("n", "_n", "before"), (F.lit(1), "_k", "dense"))])


def ranks(df: DataFrame, measure: str) -> DataFrame:
    """Adds rank (from 1, ties alike), dense_rank, mean_rank and share (of the rows that aren't over the value); null for null.

    Rows meet their value's places in a shuffle join, whose large partitions adaptive execution splits.
    """
    found = stored(places(df, measure))
    total = found.agg(F.sum("n")).first()[0] or 0
    at = found.select(
        F.col("v").alias("_v"), (F.col("before") + 1).alias("rank"), (F.col("dense") + 1).alias("dense_rank"), (F.col("before") + (F.col("n") + 1) / 2).alias("mean_rank"), ((F.col("before") + F.col("n")) / F.lit(float(total))).alias("share")
    )
    return df.join(at, F.col(measure) == F.col("_v"), "left").drop("_v")


def quantile(df: DataFrame, measure: str, p: float) -> DataFrame:
    """One row, ``cut``: the exact interpolated quantile of the values that aren't null, by their places in the order."""
    values = df.select(F.col(measure).cast("double").alias("v"))
    found = stored(places(values, "v"))
    at = p * (max(found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], 1) - 1)
    low = int(at)
    holds = lambda k: (F.col("before") <= k) & (F.col("before") + F.col("n") > k)
    pair = found.agg(F.max(F.when(holds(low), F.col("v"))).alias("a"), F.max(F.when(holds(low + 1), F.col("v"))).alias("b"))
    return pair.select((F.col("a") + (F.coalesce("b", "a") - F.col("a")) * (at - low)).alias("cut"))


def _grid(points: DataFrame, size: float, around: bool) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / size)
    if not around:
        return points.withColumns({"cx": cell("x"), "cy": cell("y")})
    step = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    return points.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).withColumns({"cx": cell("x") + F.col("dx"), "cy": cell("y") + F.col("dy")}).drop("dx", "dy")


def within(points: DataFrame, eps: float, others: DataFrame | None = None) -> DataFrame:
    """(src, dst, d2) with distance at most eps; points have id, x, y. A point meets only the nine cells around it."""
    a = _grid(points.select(F.col("id").alias("src"), "x", "y"), eps, True)
    b = _grid((points if others is None else others).select(F.col("id").alias("dst"), "x", "y"), eps, False).withColumnsRenamed({"x": "ox", "y": "oy"})
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    return a.join(b, ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") <= eps * eps).select("src", "dst", "d2")


def weights(points: DataFrame, k: int = 5, metric: str = "plane") -> DataFrame:
    """(src, dst, w): k nearest neighbours made symmetric, weights of a row add up to one."""
    e = nearest(points, points, k, itself=False, metric=metric).select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return both.withColumn("w", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("src")))


def moran(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Global Moran I of points' values (null as zero) on weighted edges: one row; zero without variance or weights."""
    v = points.select("id", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("v"))
    mean = v.agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    z = checkpoint(v.join(F.broadcast(mean), F.lit(True)).select("id", (F.col("v") - F.col("m")).alias("z"), "n"))
    cross = edges.join(z.select(F.col("id").alias("src"), F.col("z").alias("zi")), "src").join(z.select(F.col("id").alias("dst"), F.col("z").alias("zj")), "dst")
    top = cross.agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("num"), F.sum("w").alias("s0"))
    low = z.agg(F.sum(F.col("z") * F.col("z")).alias("ss"), F.max("n").alias("n"))
    return top.join(F.broadcast(low), F.lit(True)).select(F.coalesce(F.try_divide(F.col("n") * F.col("num"), F.col("s0") * F.col("ss")), F.lit(0.0)).alias("moran_i"))


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, label): the smallest id reachable, by smallest neighbour label and pointer jumping."""
    both = checkpoint(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    label = checkpoint(nodes.select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        seen = both.join(label, both.dst == label.id).groupBy("src").agg(F.min("label").alias("m"))
        step = checkpoint(label.join(seen, label.id == seen.src, "left").select("id", F.least("label", "m").alias("label"), F.col("label").alias("old")))
        up = step.select(F.col("id").alias("u"), F.col("label").alias("ul"))
        label = checkpoint(step.join(up, step.label == up.u).select("id", F.least("label", "ul").alias("label"), (F.least("label", "ul") != F.col("old")).alias("moved")))
        if label.where("moved").isEmpty():
            return label.select("id", "label")
        label = label.select("id", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _gap(a: str, b: str) -> Column:
    """Least squared distance between the boxes of two columns' structs (lx, hx, ly, hy)."""
    apart = lambda lo, hi: F.greatest(F.lit(0.0), F.col(f"{a}.{lo}") - F.col(f"{b}.{hi}"), F.col(f"{b}.{lo}") - F.col(f"{a}.{hi}"))
    return apart("lx", "hx") * apart("lx", "hx") + apart("ly", "hy") * apart("ly", "hy")


def _squared(ax: str, ay: str, bx: str, by: str) -> Column:
    return (F.col(ax) - F.col(bx)) * (F.col(ax) - F.col(bx)) + (F.col(ay) - F.col(by)) * (F.col(ay) - F.col(by))


def _boxes(points: DataFrame, level: int) -> DataFrame:
    """Of points (cell, x, y, id), the cells' parts at a level: (cell, ix, iy, n, box, px, py), the last a point that the part has."""
    part = [F.floor(F.col(c) * F.lit(float(1 << level))).alias(f"i{c[1]}") for c in ("ux", "uy")]
    box = F.struct(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy")).alias("box")
    return points.select("cell", "id", "x", "y", *part).groupBy("cell", "ix", "iy").agg(F.count(F.lit(1)).alias("n"), box, F.min(F.struct("id", "x", "y")).alias("p"))


def linked_cells(points: DataFrame, pairs: DataFrame, eps: float, direct: int = 256) -> DataFrame:
    """(a, b): which of the ``pairs`` of cells hold points within eps. Points have cell, id, x, y and their place in the cell as ux, uy from 0 to 1.

    Pruned search for one near pair: two parts are linked if the points that stand for them are near, out if their boxes
    are too far apart, listed if they have at most ``direct`` pairs of points, and else cut into quarters. A pair of cells that is
    linked is left at once, so nothing grows with the points of crowded cells.
    """
    first = checkpoint(_boxes(points, 0).drop("ix", "iy"))
    side = lambda boxes, s, *more: boxes.select(*[F.col(c).alias(f"{s}_{c}") for c in boxes.columns])
    alive = pairs.join(side(first, "a"), F.col("a") == F.col("a_cell")).join(side(first, "b"), F.col("b") == F.col("b_cell")).drop("a_cell", "b_cell")
    alive = alive.withColumns({f"{s}_i{c}": F.lit(0).cast("long") for s in "ab" for c in "xy"})
    out, level = None, 0
    while True:
        near = _squared("a_p.x", "a_p.y", "b_p.x", "b_p.y") <= eps * eps
        few = (F.col("a_n") * F.col("b_n") <= direct) | F.lit(level >= DEEPEST)
        judged = checkpoint(alive.withColumns({"near": near, "few": few}).where((_gap("a_box", "b_box") <= eps * eps) | F.col("near")))
        done = judged.where("near").select("a", "b").distinct()
        rest = checkpoint(judged.where("not near").join(done, ["a", "b"], "left_anti"))
        out = done if out is None else out.unionByName(done)
        if rest.isEmpty():
            return out.distinct()
        few = rest.where("few").select("a", "a_ix", "a_iy", "b", "b_ix", "b_iy")
        place = lambda s: points.select(F.col("cell").alias(s), *[F.floor(F.col(f"u{c}") * F.lit(float(1 << level))).alias(f"{s}_i{c}") for c in "xy"], *[F.col(c).alias(f"{s}_{c}") for c in "xy"])  # noqa: B023, E731
        found = few.join(place("a"), ["a", "a_ix", "a_iy"]).join(place("b"), ["b", "b_ix", "b_iy"]).where(_squared("a_x", "a_y", "b_x", "b_y") <= eps * eps).select("a", "b").distinct()
        found = checkpoint(found)
        out = out.unionByName(found)
        large = rest.where("not few").join(found, ["a", "b"], "left_anti").select("a", "b", "a_ix", "a_iy", "b_ix", "b_iy")
        level += 1
        quarters = checkpoint(_boxes(points.join(large.select(F.explode(F.array("a", "b")).alias("cell")).distinct(), "cell", "left_semi"), level))
        up = quarters.withColumns({"ux": F.shiftright("ix", 1), "uy": F.shiftright("iy", 1)})
        for s in "ab":
            of = side(up, s).withColumnsRenamed({f"{s}_cell": s, f"{s}_ix": f"{s}_kx", f"{s}_iy": f"{s}_ky", f"{s}_ux": f"{s}_ix", f"{s}_uy": f"{s}_iy"})
            large = large.join(of, [s, f"{s}_ix", f"{s}_iy"]).drop(f"{s}_ix", f"{s}_iy").withColumnsRenamed({f"{s}_kx": f"{s}_ix", f"{s}_ky": f"{s}_iy"})
        alive = large


class Density:
    """Cells with a diagonal of eps, whose members are all neighbours, and which points of them are core.

    A cell with ``least`` points is core as a whole, so nobody in it looks for neighbours. The others have fewer than ``least``
    points each, so a point meets at most 24 * (least - 1) of those: pairs grow with the points, however crowded a cell is.
    """

    def __init__(self, points: DataFrame, eps: float, least: int) -> None:
        if eps <= 0:
            raise ValueError("eps over 0")
        self.eps, self.least = eps, least
        side = eps / 2**0.5 * (1 - 1e-9)
        cell = {f"c{c}": F.floor(F.col(c) / side) for c in "xy"}
        known = points.select("id", "x", "y").where("not isnan(x) and not isnan(y)").withColumns(cell)
        place = {f"u{c}": F.least(F.greatest(F.col(c) / side - F.col(f"c{c}"), F.lit(0.0)), F.lit(1 - 2.0**-40)) for c in "xy"}
        self.cells = checkpoint(known.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("cell")))
        self.points = checkpoint(known.withColumns(place).join(self.cells, ["cx", "cy"]))
        sparse = self.points.where(F.col("n") < least)
        self.sparse = sparse.select(F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"), "cx", "cy")
        near = self.near(self.points).groupBy("src").agg(F.count(F.lit(1)).alias("near"))
        core = near.where(F.col("near") >= least).select(F.col("src").alias("id"))
        self.core = checkpoint(self.points.where(F.col("n") >= least).select("id").unionByName(core))

    def around(self, rows: DataFrame, itself: bool = True) -> DataFrame:
        """``rows`` (cx, cy) once for each cell that may hold neighbours, as (tx, ty)."""
        step = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if itself or i or j])
        return rows.withColumn("_s", F.explode(step)).withColumns({"tx": F.col("cx") + F.col("_s.i"), "ty": F.col("cy") + F.col("_s.j")}).drop("_s")

    def near(self, others: DataFrame) -> DataFrame:
        """(src, dst): the neighbours, itself included, of points in sparse cells among ``others``."""
        to = others.select(F.col("id").alias("dst"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("cx").alias("tx"), F.col("cy").alias("ty"))
        met = self.around(self.sparse).join(to, ["tx", "ty"]).where(_squared("sx", "sy", "ox", "oy") <= self.eps * self.eps)
        return met.select("src", "dst")


def core_points(points: DataFrame, eps: float, least: int = 5) -> DataFrame:
    """(id) of the points with at least ``least`` points within eps, itself included."""
    return Density(points, eps, least).core


def dbscan(points: DataFrame, eps: float, least: int = 5) -> DataFrame:
    """(id, core, cluster): clusters numbered from 0 by their smallest core id, noise -1, border points to the lowest cluster.

    Components are those of cells, not of points: a cell's core points are all neighbours, and two cells are linked if one pair of their core points
    is near. Points without coordinates are noise.
    """
    grid = Density(points, eps, least)
    core = checkpoint(grid.points.drop("cell", "n").join(grid.core, "id", "left_semi"))
    cells = checkpoint(core.groupBy("cx", "cy").agg(F.min("id").alias("cell")))
    named = checkpoint(core.join(cells, ["cx", "cy"]))
    pairs = grid.around(cells.withColumnRenamed("cell", "a"), False).join(cells.select(F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("cell").alias("b")), ["tx", "ty"]).where("a < b").select("a", "b")
    label = components(linked_cells(named, checkpoint(pairs), eps).withColumnsRenamed({"a": "src", "b": "dst"}), cells.select(F.col("cell").alias("id")))
    numbered = ordinal(label.select("label").distinct(), ["label"]).withColumnRenamed("ordinal", "cluster")
    numbered = label.join(numbered, "label").select(F.col("id").alias("cell"), "cluster")
    own = checkpoint(named.join(numbered, "cell").select("id", "cx", "cy", "x", "y", "cluster"))
    # border points are in sparse cells
    reach = grid.near(own).join(own.select(F.col("id").alias("dst"), "cluster"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("cluster").alias("near_cluster"))
    out = points.select("id").join(own.select("id", F.col("cluster").alias("own")), "id", "left").join(reach, "id", "left")
    return out.select("id", F.col("own").isNotNull().alias("core"), F.coalesce("own", "near_cluster", F.lit(-1)).cast("long").alias("cluster"))
