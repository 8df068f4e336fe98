"""Operator 7, SimHash near-dedup with BK-trees.

A fingerprint has 64 bits from the XXH64 hashes of a text's word shingles. Fingerprints are links if at most
``radius`` bits differ. Distinct fingerprints are dealt to buckets so that any two within the radius share a bucket
(the fingerprint is cut into four blocks; with two bits changed, two blocks at least are equal), and each bucket, or
each shard of a large one, becomes a BK-tree: children are keyed by their Hamming distance to the parent, and a search
follows only edges within the radius. Large buckets are cut into shards of ``shard`` fingerprints; every shard's tree is
sent to the bucket's other shards as query blocks, so no task holds an unbounded group and no link is lost.

Cases: null text counts as empty and has fingerprint zero; fewer words than a shingle make one shingle of the whole
sequence; repeated rows share a fingerprint and so a component, of which one row stays; rows without doc_id rank last, are
told apart by their texts, and their component_id is null if none of the component has one; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST, blocks, checkpoint, components, identity, salted_join, with_small, without

BLOCKS = 4
BITS = 64 // BLOCKS


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """64 bits as a signed integer; bit i is set if it is set in over half of the shingles' hashes."""
    import numpy as np
    import xxhash

    words = data.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, 42) for g in grams), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc, th, fp) by the identity of the document: one pass over the texts, no shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in blocks(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fingerprint(t or b"", shingle) for t in b.column(2).to_pylist()], pa.int64())], ["doc", "th", "fp"])

    rows = docs.select(*identity(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc long, th long, fp long")


class BKTree:
    """Integers under the Hamming distance."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ x).bit_count()
            if d == 0:
                return
            below = node[1].get(d)
            if below is None:
                node[1][d] = [x, {}]
                return
            node = below

    def near(self, x: int, radius: int) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            value, edges = todo.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                yield value
            for e, below in edges.items():
                if d - radius <= e <= d + radius:
                    todo.append(below)


def links(fps: DataFrame, radius: int = 2, shard: int = 1024) -> DataFrame:
    """(src, dst): links between distinct fingerprints that span the same components as all pairs within the radius.

    A search in a tree of shard i by a fingerprint of shard i or j gives one link for each group that it meets and that
    this tree hasn't joined yet, so a dense bucket gives links in proportion to its members.
    """
    if radius > BLOCKS - 2:
        raise ValueError(f"radius up to {BLOCKS - 2}")
    parts = [F.shiftrightunsigned("fp", BITS * i).bitwiseAND((1 << BITS) - 1) for i in range(BLOCKS)]
    keys = F.array(*[F.lit(k) * F.lit(1 << 32) + parts[i] * F.lit(1 << BITS) + parts[j] for k, (i, j) in enumerate(combinations(range(BLOCKS), 2))])
    members = fps.select("fp", F.explode(keys).alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = salted_join(members, sizes, "bucket", "n", F.col("fp"), 6 * fps.count())
    own = shared.withColumn("shards", F.ceil(F.col("n") / shard).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
    # a fingerprint of shard s is in the tree of every pair (s, j >= s) and asks the tree of every pair (i < s, s)
    dealt = own.select("bucket", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("other")).select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("build"), "fp"
    )

    def search(batches: Iterator) -> Iterator:
        """Rows come sorted by bucket, pair and trees first: one tree is held at a time."""
        import pyarrow as pa

        now, tree, group = None, BKTree(), {}

        def top(x: int) -> int:
            while group[x] != x:
                group[x] = group[group[x]]
                x = group[x]
            return x

        for b in batches:
            pairs: list[tuple[int, int]] = []
            for bucket, i, j, build, fp in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if (bucket, i, j) != now:
                    now, tree, group = (bucket, i, j), BKTree(), {}
                x = fp & (2**64 - 1)
                if build and i != j:
                    tree.add(x)
                    group[x] = x
                    continue
                met = {top(y): y for y in tree.near(x, radius)}
                pairs += ((x, y) for y in met.values())
                if build:
                    tree.add(x)
                    group[x] = x
                    met[x] = x
                root = min(met, default=x)
                group.update(dict.fromkeys(met, root))
            signed = [[v - 2**64 if v >> 63 else v for v in side] for side in zip(*pairs, strict=True)] or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in signed], ["src", "dst"])

    rows = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", F.desc("build"))
    return rows.select("bucket", "i", "j", "build", "fp").mapInArrow(search, "src long, dst long").distinct()


def classes(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """(doc, th, fp, first_doc, first_th): every row with its fingerprint and the first document of its component."""
    fps = checkpoint(fingerprints(docs, shingle))
    distinct = checkpoint(fps.groupBy("fp").agg(F.min(F.struct("doc", "th")).alias("first"), F.count(F.lit(1)).alias("n")))
    found = components(links(distinct.select("fp"), radius))
    # a component of fingerprints takes the smallest document of all its fingerprints
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("component"))
    smallest = checkpoint(named.groupBy("component").agg(F.min("first").alias("top"), F.count(F.lit(1)).alias("k")))
    total = distinct.count()
    tops = checkpoint(with_small(named.select("fp", "n", "component"), smallest, "component", "k", F.col("fp"), total).select("fp", "n", F.col("top.doc").alias("first_doc"), F.col("top.th").alias("first_th")))
    # copies of one text may be a third of all rows
    return with_small(fps, tops, "fp", "n", F.struct("doc", "th"), fps.count()).select("doc", "th", "fp", "first_doc", "first_th")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id reachable."""
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return classes(docs, radius, shingle).select(known("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), known("first_doc").alias("component_id"))


def deduplicated(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row of each component, that of the smallest doc_id (and text digest); all columns stay."""
    rows = checkpoint(classes(docs, radius, shingle))
    first = rows.where("doc = first_doc and th = first_th")
    kept = without(docs, rows.where("doc <> first_doc or th <> first_th"))
    # rows of one doc_id and text are in one component, so one of them stays
    again = first.groupBy("doc", "th").count().where("count > 1").select("doc", "th")
    if again.isEmpty():
        return kept
    doc, th = identity(docs)
    marked = kept.withColumns({"_d": doc, "_t": th})
    single = without(kept, again)
    repeated = marked.join(checkpoint(again).withColumnsRenamed({"doc": "_d", "th": "_t"}), ["_d", "_t"], "left_semi").dropDuplicates(["_d", "_t"])
    return single.unionByName(repeated.drop("_d", "_t"))
