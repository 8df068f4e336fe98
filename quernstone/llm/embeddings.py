"""Operator 11, embedding near-dedup by cross-polytope hashing.

Equal vectors are one class from the start. A class is rotated by random signs and fast Hadamard transforms, three times each; its
hash is the axis (with sign) that it is nearest to. ``hashes`` such values make a bucket of one table. Multiprobe: a class
goes to the buckets of the two nearest axes of each hash, and two classes are candidates if any of their buckets in a
table agree. How often that happens at the threshold itself is simulated for the dimension, and there are as many tables as
leave a pair at the threshold unseen with probability ``MISS`` at most. ``hashes`` follows the counted classes, so that buckets
of unrelated vectors stay small; the tables follow ``hashes``, so that recall doesn't change with size.

What is dealt to the buckets is not the vectors but 256 signs of their rotations; two vectors over the threshold agree in so many
of them (four standard deviations below the mean) that the others needn't be compared. Only members that have such a
partner fetch their vectors; every candidate pair is then verified by its cosine. A pair is counted in the first bucket that both
share, so no list of pairs is shuffled: tasks give each member's number of links and one edge to what it is linked with there.
Large buckets are cut into shards, and each pair of shards is a group of its own.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so do vectors of different
lengths; rows with equal vectors link with each other, rows that are repeated as a whole too; rows without vec_id rank last, have
component_id null if none of the component has one, and are kept then; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST, checkpoint, components, with_small

THRESHOLD = 0.9
#: A pair at the threshold is in no common bucket with this probability (a little more in very few dimensions, where tables aren't independent).
MISS = 0.003
#: Expected unrelated partners of a class in a table; one hash more divides them by half the axes.
PARTNERS = 4096
SIGNS = 256
#: Members of a bucket that are compared at once.
SHARD = 2048
SEED = 11


def padded(dim: int) -> int:
    return max(16, 1 << (dim - 1).bit_length())


def hadamard(x):
    """The fast Walsh-Hadamard transform of each row, with lengths kept."""
    import numpy as np

    n, width = x.shape
    h = 1
    while h < width:
        pairs = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / math.sqrt(width)


def rotated(x, number: int, seed: int = SEED):
    import numpy as np

    rng = np.random.default_rng([seed, number, x.shape[1]])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def axes(y):
    """(rows, 2): the nearest and the second nearest axis, an even number for its positive end."""
    import numpy as np

    size, row = np.abs(y), np.arange(len(y))
    first = size.argmax(axis=1)
    size[row, first] = -1
    both = np.stack([first, size.argmax(axis=1)], axis=1)
    return both * 2 + (np.take_along_axis(y, both, axis=1) < 0)


def rotations(x, hashes: int, tables: int) -> Iterator:
    """(number, rotated rows): as many as the tables and the signs need."""
    import numpy as np

    width = padded(x.shape[1])
    x = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, width - x.shape[1])))
    return ((number, rotated(x, number)) for number in range(max(hashes * tables, SIGNS // width)))


def signs_of(turned: list):
    """(rows, 4) unsigned integers: the first SIGNS signs."""
    import numpy as np

    return np.packbits(np.concatenate([y < 0 for y in turned], axis=1)[:, :SIGNS], axis=1).view("<u8")


@lru_cache(maxsize=64)
def simulated(dim: int, threshold: float) -> tuple[float, int]:
    """From 4,000 simulated pairs with the cosine ``threshold``: the share that has one of the two nearest axes in common, and
    the most signs that may differ (four standard deviations over the mean)."""
    import numpy as np

    rng = np.random.default_rng([SEED, dim])
    a, e = rng.normal(size=(2, 4000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    e -= (e * a).sum(axis=1, keepdims=True) * a
    e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-300)
    one, two = ([y for _, y in rotations(v, 1, 1)] for v in (a, threshold * a + math.sqrt(1 - threshold * threshold) * e))
    apart = np.bitwise_count(signs_of(one) ^ signs_of(two)).sum(axis=1)
    met = (axes(one[0])[:, :, None] == axes(two[0])[:, None, :]).any(axis=(1, 2))
    return float(met.mean()), math.ceil(apart.mean() + 4 * apart.std())


def tables_for(classes: int, dim: int, threshold: float) -> tuple[int, int]:
    """(hashes of a bucket, tables)."""
    hashes = 1
    while classes * (2 / padded(dim)) ** hashes > PARTNERS:
        hashes += 1
    seen = simulated(dim, threshold)[0] ** hashes
    return hashes, 1 if seen >= 1 else max(1, math.ceil(math.log(MISS) / math.log(1 - seen)))


def _mixed(x):
    """SplitMix64 of unsigned 64-bit integers: buckets spread over all values."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(x, classes: int, threshold: float):
    """(signs as (rows, 4) unsigned integers, buckets as (rows, tables, probes)) of the rows of x, all of one length."""
    import numpy as np

    width, (hashes, tables) = padded(x.shape[1]), tables_for(classes, x.shape[1], threshold)
    turned, keys = [], np.empty((len(x), tables, 2**hashes), dtype=np.uint64)
    for number, y in rotations(x, hashes, tables):
        if len(turned) * width < SIGNS:
            turned.append(y)
        table, place = divmod(number, hashes)
        if table >= tables:
            continue
        near = axes(y).astype(np.uint64)
        if place == 0:
            code = np.zeros((len(x), 1), dtype=np.uint64)
        code = (code[:, :, None] * np.uint64(2 * width) + near[:, None, :]).reshape(len(x), -1)
        if place == hashes - 1:
            keys[:, table] = _mixed(code * np.uint64(64) + np.uint64(table) + _mixed(np.full(1, x.shape[1] * 4096 + table, dtype=np.uint64)))
    return signs_of(turned), keys


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, vec): the components as bytes, null for vectors that link with nothing."""
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            lists = b.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            # zero is one value whatever its sign
            flat = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False) + 0.0
            end = np.cumsum(size)
            count = lambda m: np.diff(np.concatenate(([0], np.cumsum(m)))[np.concatenate(([0], end))])  # noqa: B023, E731
            good = (count(~np.isfinite(flat)) == 0) & (count(flat != 0) > 0)
            flat = flat.astype("<f4" if single else "<f8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[e - s : e].tobytes() if g else None for g, s, e in zip(good, size, end, strict=True)], pa.binary())], ["vec_id", "vec"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, vec binary")


def _matrix(column, single: bool):
    """Rows of doubles, each divided by its largest power of two so that squares stay finite."""
    import numpy as np

    x = np.frombuffer(b"".join(column), dtype="<f4" if single else "<f8").astype(np.float64).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _signatures(classes: DataFrame, n: int, single: bool, threshold: float) -> DataFrame:
    """(cid, dim, signs, keys) of every class."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids, vecs = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            size = np.array([len(v) for v in vecs])
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                for part in np.array_split(at, len(at) // 2048 + 1):
                    signs, keys = hashed(_matrix([vecs[i] for i in part], single), n, threshold)
                    keys = keys.view(np.int64).reshape(len(part), -1)
                    dim = np.full(len(part), s // (4 if single else 8), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(dim), pa.array([x.tobytes() for x in signs], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["cid", "dim", "signs", "keys"])

    return classes.select("cid", "vec").mapInArrow(run, "cid long, dim int, signs binary, keys array<long>")


def _dealt(member: DataFrame, shard: int) -> DataFrame:
    """Members (bucket, cid, ...) in groups (bucket, i, j) of a pair of shards, ``own`` telling the two apart, sorted by group."""
    sizes = checkpoint(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1))
    total = int(sizes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0])
    rows = with_small(member, sizes, "bucket", "m", F.col("cid"), total).withColumn("shards", F.ceil(F.col("m") / shard).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("shards")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("m", "shards", "other")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _groups(batches: Iterator) -> Iterator:
    """Batches with the rows of one (bucket, i, j), which are the first columns; at most two shards are held."""
    import numpy as np
    import pyarrow as pa

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        now = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b]).combine_chunks()
        keys = [now.column(k).to_numpy() for k in range(3)]
        cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        edge = [0, *cut.tolist()]
        for a, z in zip(edge, edge[1:], strict=False):
            yield now.slice(a, z - a)
        held = now.slice(edge[-1])
    if held is not None:
        yield held


def _lengths(group) -> Iterator:
    """Parts whose vectors have the same length; nearly always the one group."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = pc.binary_length(group.column("vec"))
    for s in pc.unique(size):
        yield group if pc.all(pc.equal(size, s)).as_py() else group.filter(pc.equal(size, pa.scalar(s.as_py(), size.type)))


def _sides(group) -> tuple:
    """Row numbers of the two sides: all and all, or the two shards."""
    import numpy as np

    i, j = (group.column(k)[0].as_py() for k in ("i", "j"))
    if i == j:
        every = np.arange(group.num_rows)
        return every, every
    own = group.column("own").to_numpy()
    return np.flatnonzero(own == i), np.flatnonzero(own == j)


def _partnered(member: DataFrame, threshold: float, shard: int) -> DataFrame:
    """(bucket, cid) of members whose signs are like another one's in the bucket."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for g in _groups(batches):
            one, two = _sides(g)
            signs = np.frombuffer(b"".join(g.column("signs").to_pylist()), dtype="<u8").reshape(g.num_rows, -1)
            apart = np.zeros((len(one), len(two)), dtype=np.uint16)
            for k in range(signs.shape[1]):
                apart += np.bitwise_count(signs[one, k, None] ^ signs[None, two, k])
            near = apart <= simulated(g.column("dim")[0].as_py(), threshold)[1]
            if one is two:
                np.fill_diagonal(near, False)
            found = np.union1d(one[near.any(axis=1)], two[near.any(axis=0)])
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(g.column(c).to_numpy()[found]) for c in ("bucket", "cid")], ["bucket", "cid"])

    rows = _dealt(member, shard).select("bucket", "i", "j", "own", "cid", "dim", "signs")
    return rows.mapInArrow(run, "bucket long, cid long").distinct()


def _verified(member: DataFrame, single: bool, threshold: float, shard: int, n: int) -> DataFrame:
    """(cid, links, top): what each member links with among the pairs whose first common bucket this is, and one class of its component."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        # lengths share a bucket only if their digests meet
        for g in (part for group in _groups(batches) for part in _lengths(group)):
            one, two = _sides(g)
            x = _matrix(g.column("vec").to_pylist(), single)
            size = np.linalg.norm(x, axis=1)
            unit = x / size[:, None]
            r, c = np.nonzero(unit[one] @ unit[two].T >= threshold - 1e-9)
            r, c = one[r], two[c]
            if one is two:
                r, c = r[r < c], c[r < c]
            cid, keys = g.column("cid").to_numpy(), np.array(g.column("keys").to_pylist(), dtype=np.int64)
            _, tables = tables_for(n, x.shape[1], threshold)
            keys = keys.reshape(g.num_rows, tables, -1)
            bucket, weight = g.column("bucket")[0].as_py(), g.column("n").to_numpy()
            links, top = np.zeros(g.num_rows, dtype=np.int64), np.arange(g.num_rows)
            left, right = [], []
            for at in range(0, len(r), 1 << 16):
                a, b = r[at : at + (1 << 16)], c[at : at + (1 << 16)]
                near = np.einsum("ij,ij->i", x[a], x[b]) / (size[a] * size[b]) >= threshold
                a, b = a[near], b[near]
                for t in range(tables):
                    if not len(a):
                        break
                    both = keys[a, t][:, :, None] == keys[b, t][:, None, :]
                    least = np.where(both.any(axis=2), keys[a, t], np.iinfo(np.int64).max).min(axis=1)
                    here = least == bucket
                    left.append(a[here])
                    right.append(b[here])
                    later = ~both.any(axis=(1, 2))
                    a, b = a[later], b[later]
            if not left:
                continue
            a, b = np.concatenate(left), np.concatenate(right)
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            while True:
                low = np.minimum(top[a], top[b])
                before = top.copy()
                np.minimum.at(top, a, low)
                np.minimum.at(top, b, low)
                top = top[top]
                if (top == before).all():
                    break
            found = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(cid[found]), pa.array(links[found]), pa.array(cid[top[found]])], ["cid", "links", "top"])

    rows = _dealt(member, shard).select("bucket", "i", "j", "own", "cid", "n", "vec", "keys")
    return rows.mapInArrow(run, "cid long, links long, top long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold over 0, up to 1")
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    all_rows = checkpoint(vectors(rows).withColumn("d", F.md5("vec")))
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    grouped = all_rows.where("d is not null").groupBy("d").agg(F.min(F.coalesce("vec_id", F.lit(LAST))).alias("first"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    classes = checkpoint(grouped.withColumn("cid", F.monotonically_increasing_id()))
    count = classes.count()
    signed = checkpoint(_signatures(classes, count, single, threshold))
    member = signed.select("cid", "dim", "signs", F.explode(F.array_distinct("keys")).alias("bucket"))
    active = checkpoint(_partnered(member, threshold, shard))
    fetched = active.join(classes.select("cid", "n", "vec"), "cid").join(signed.select("cid", "keys"), "cid")
    found = checkpoint(_verified(fetched, single, threshold, shard, count))
    label = components(found.where("cid <> top"), "cid", "top")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.select("cid", "d", "n", "first").join(label.withColumnRenamed("node", "cid"), "cid", "left").join(links, "cid", "left")
    named = checkpoint(named.select("cid", "d", "n", "first", F.coalesce("component", "cid").alias("c"), F.coalesce("links", F.lit(0)).alias("links")))
    tops = checkpoint(named.groupBy("c").agg(F.min("first").alias("top"), F.count(F.lit(1)).alias("k")))
    each = checkpoint(with_small(named, tops, "c", "k", F.col("cid"), count).select("d", "n", (F.col("links") + F.col("n") - 1).alias("links"), "top"))
    total = all_rows.count()
    spread = F.coalesce("vec_id", F.monotonically_increasing_id())
    linked = with_small(all_rows.where("d is not null").select("vec_id", "d"), each, "d", "n", spread, total).select("vec_id", "links", known("top").alias("component_id"))
    alone = all_rows.where("d is null").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", F.col("links").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def oracle() -> str:
    """DuckDB SQL: all pairs, then what is reachable."""
    return f"""
with recursive v as (select vec_id, embedding::double[] e from embeddings where embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= {THRESHOLD}),
reach(a, b) as (select vec_id, vec_id from embeddings union select reach.a, link.b from reach join link on reach.b = link.a),
top as (select a vec_id, min(b) component_id from reach group by a),
n as (select a vec_id, count(*) n_links from link group by a)
select vec_id, coalesce(n_links, 0)::bigint n_links, component_id, vec_id = component_id kept from top left join n using (vec_id)"""
