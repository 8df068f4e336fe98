"""What the corpus operators share: tables, checkpoints, skew-proof joins and components."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.storage import shared_folder, work_folder  # noqa: F401

#: Keys with more than this share of all rows are dealt out over SALTS tasks. At most 1/HOT_SHARE keys can
#: be hot, so the set of hot keys has a fixed size bound and may be broadcast.
HOT_SHARE = 1 / 20_000
SALTS = 64
#: A side is broadcast only if its counted rows and measured bytes are below these; as a hashed relation it is
#: several times that in the driver.
BROADCAST_ROWS = 30_000
BROADCAST_BYTES = 16 << 20
#: For rows of a few integers; some 30 MB as a hashed relation.
NARROW_ROWS = 300_000
#: Rows of a few integers in one file of a small table.
FILE_ROWS = 50_000
#: Rank of rows without an id: behind all others.
LAST = (1 << 63) - 1
#: A Python task works on so many rows and about so many bytes of text at once; Spark hands it batches of up to 64 MB by its own setting.
BLOCK_ROWS = 256
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame, compression: str = "zstd", rows: int | None = None) -> DataFrame:
    """Cut the lineage by a Parquet table in the session's shared folder; of up to ``rows`` rows, if that is known, in as few files as hold them.

    Unlike Dataset.checkpoint it is compressed, read by column, and of known size: the planner takes a checkpoint's size
    from the plan that made it, a product over its joins that soon has too many digits to compute with in a loop.
    """
    at = work_folder(df.sparkSession)
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    df.write.option("compression", compression).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def documents_of(df: DataFrame) -> DataFrame:
    """The two columns that text operators read, so that other columns can't clash; null text counts as empty."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def identity(docs: DataFrame) -> tuple[Column, Column]:
    """(doc, th): what tells rows apart; rows of the same doc_id and text are the same document. Null ids rank last."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("th")


def blocks(batches: Iterator, column: int) -> Iterator:
    """Slices of Arrow batches with up to BLOCK_ROWS rows and about BLOCK_BYTES bytes in a text column; a longer text stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            done = int(ends[at - 1]) if at else 0
            upto = int(np.searchsorted(ends, done + BLOCK_BYTES, side="right"))
            upto = min(max(upto, at + 1), at + BLOCK_ROWS, b.num_rows)
            yield b.slice(at, upto - at)
            at = upto


def salted_join(big: DataFrame, small: DataFrame, key: str, count: str, spread: Column, total: int, how: str = "inner") -> DataFrame:
    """Equi join of many rows with one row per key, where a key may hold any share of ``big``.

    ``small`` has a column ``count`` with the rows of its key in ``big``. Keys over HOT_SHARE of ``total`` are hot:
    their rows go to SALTS tasks by ``spread``, and their row of ``small`` is repeated as often. Everything else
    is a plain shuffle join.
    """
    limit = max(1000, int(total * HOT_SHARE))
    hot = small.where(F.col(count) > limit).select(F.col(key).alias("_hot_key"))
    left = big.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_salt", F.when(F.col("_hot_key").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    )
    right = small.withColumn("_salt", F.explode(F.when(F.col(count) > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.drop("_hot_key").join(right, [key, "_salt"], how).drop("_salt")


def with_small(big: DataFrame, small: DataFrame, key: str, count: str, spread: Column, total: int, how: str = "inner", most: int = NARROW_ROWS) -> DataFrame:
    """``big`` joined with one row per key: broadcast if that is few rows when counted, else by shuffle with salt for hot keys."""
    if small.count() <= most:
        return big.join(F.broadcast(small), key, how)
    return salted_join(big, small, key, count, spread, total, how)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the documents (doc, th) of ``gone``, whatever columns it has: broadcast if those are few when counted."""
    doc, th = identity(docs)
    key = F.xxhash64(doc, th)
    gone = checkpoint(gone.select(F.xxhash64("doc", "th").alias("_gone")).distinct())
    side = F.broadcast(gone) if gone.count() <= NARROW_ROWS else gone
    return docs.join(side, key == F.col("_gone"), "left_anti")


def sized_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """A broadcast hint if the counted rows fit BROADCAST_ROWS and BROADCAST_BYTES, else the frame as it is (a shuffle join)."""
    n = df.count()
    return F.broadcast(df) if n <= BROADCAST_ROWS and n * row_bytes <= BROADCAST_BYTES else df


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60, rows: int | None = None) -> DataFrame:
    """Distributed union-find: (node, component) for every node of an edge, component = the smallest node reachable.

    Each round takes the smallest label among the neighbours and then follows it once to that label's own label
    (pointer jumping), so rounds grow with the logarithm of the diameter. Nothing is collected but one flag. Nodes with
    very many neighbours and labels of very many nodes are only in plain shuffle joins, whose large partitions adaptive
    execution splits; the aggregations combine before the shuffle. Of up to ``rows`` edges, if that is known, tables are in few files.
    """
    twice = None if rows is None else 2 * rows
    both = edges.select(F.col(src).alias("b"), F.col(dst).alias("a")).where("a is not null and b is not null")
    both = checkpoint(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), rows=twice)
    label = checkpoint(both.groupBy("b").agg(F.least(F.col("b"), F.min("a")).alias("c")), rows=twice)
    for _ in range(rounds):
        seen = both.join(label, "b").groupBy("a").agg(F.min("c").alias("m"))
        step = checkpoint(label.join(seen, F.col("b") == F.col("a")).select("b", F.least("c", "m").alias("c"), F.col("c").alias("old")), rows=twice)
        up = step.select(F.col("b").alias("_b"), F.col("c").alias("up"))
        label = checkpoint(step.join(up, F.col("c") == F.col("_b")).select("b", F.least("c", "up").alias("c"), (F.least("c", "up") != F.col("old")).alias("moved")), rows=twice)
        if label.where("moved").isEmpty():
            return label.select(F.col("b").alias("node"), F.col("c").alias("component"))
        label = label.select("b", "c")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
