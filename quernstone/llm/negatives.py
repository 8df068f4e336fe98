"""Operator 12, hard-negative mining by threshold joins in the manner of L2AP.

Rows have integer components. Anchors are compared with all rows: first for positives, the best rows of the same label;
then, for each positive, for the best rows of another label whose scores lie in a window below the positive's score.

Both are threshold joins. A task takes a block of rows, puts the dimensions with the most energy first and keeps an inverted index:
the list of a dimension group holds the rows with a value there, those with the largest norm up to that group first. If an
anchor asks for the score ``t``, rows whose norm up to a group is below t over the anchor's norm needn't be in its list, since what
they share in these dimensions can't reach t; so the lists' heads are the index for any threshold. Partial scores are added
up from the last group to the first; pairs whose partial score and remaining norms can't reach t are pruned halfway and at the end, and the
others get their exact score. Rounds begin with a high threshold and go on with a lower one for the windows
that aren't full yet; the last round has the window's own lower end (for positives, none), so results are exact. Within a task
the threshold of a full window rises with what has been found.

Anchors are taken in blocks of ``ANCHOR_BYTES``, which tasks get by broadcast; what comes back to the driver is the k best
scores of a block's windows. Rows are neither shuffled nor joined after repeated ones are dropped; work grows with anchors times rows.

Cases: rows with null vec_id or label, null vectors and vectors with null or non-finite components (256-fold) take no part; a
shorter vector counts as filled up with zeros; rows that are repeated as a whole count once; rows of the same vec_id are never
each other's positive or negative; ties go to the smaller vec_id; scores beyond 2^53 are compared exactly and given as the
nearest long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Bytes of the anchors that are broadcast at once.
ANCHOR_BYTES = 16 << 20
#: Dimensions of one list of the index, rows of an index, anchors that ask it at once.
GROUP, ROWS, TILE = 8, 4096, 256
#: Thresholds of the rounds: for positives shares of the mean norm's score, for negatives shares of the window.
POSITIVE_ROUNDS = (0.8, 0.5, 0.3, None)
NEGATIVE_ROUNDS = (0.25, 0.6, 1.0)
#: Candidates that a task holds before it keeps the best of each window.
POOL = 200_000
EXACT = float(1 << 53)


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, q, norm): floor(scale * x) of each component as doubles in bytes; rows that take no part are left out."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            lists = b.column(2)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            with np.errstate(over="ignore"):
                flat = np.floor(scale * pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False)) + 0.0
            end = np.cumsum(size)
            bad = np.diff(np.concatenate(([0], np.cumsum(~np.isfinite(flat))))[np.concatenate(([0], end))])
            keep = np.flatnonzero((bad == 0) & ~lists.is_null().to_numpy(zero_copy_only=False))
            parts = [flat[end[k] - size[k] : end[k]].astype("<f8") for k in keep]
            norm = [float(np.linalg.norm(p)) if len(p) else 0.0 for p in parts]
            taken = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(norm, pa.float64())], ["vec_id", "label", "q", "norm"])

    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where("vec_id is not null and label is not null").mapInArrow(run, "vec_id long, label long, q binary, norm double")


def matrix(column: list[bytes], width: int = 0):
    """Rows of doubles, filled up with zeros to the longest or to ``width``."""
    import numpy as np

    width = max([width, *(len(v) // 8 for v in column)])
    return np.frombuffer(b"".join(v.ljust(8 * width, b"\0") for v in column), dtype="<f8").reshape(len(column), width)


class Index:
    """A block of rows: lists of dimension groups, from which the pairs at or over a threshold are found."""

    def __init__(self, rows) -> None:
        import numpy as np

        self.order = np.argsort(-np.square(rows).sum(axis=0), kind="stable")
        self.rows = rows[:, self.order]
        self.cuts = list(range(0, rows.shape[1], GROUP)) + [rows.shape[1]]
        self.before = self._norms(self.rows)
        self.lists = []
        for g in range(len(self.cuts) - 1):
            there = np.flatnonzero(self.rows[:, self.cuts[g] : self.cuts[g + 1]].any(axis=1))
            there = there[np.argsort(-self.before[there, g + 1], kind="stable")]
            self.lists.append((there, -self.before[there, g + 1]))

    def _norms(self, x):
        """(rows, groups + 1): the norm of the dimensions before each group."""
        import numpy as np

        total = np.concatenate([np.zeros((len(x), 1)), np.cumsum(np.square(x), axis=1)], axis=1)
        return np.sqrt(total[:, self.cuts])

    def pairs(self, anchors, least):
        """(anchor, row, score) of all pairs whose score is at least the anchor's in ``least``."""
        import numpy as np

        a = anchors[:, self.order]
        norms = self._norms(a)
        whole, rough = norms[:, -1], np.asarray(least, dtype=float)
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(whole > 0, rough / whole, -np.inf).min() * (1 - 1e-9)
        score = np.zeros((len(a), len(self.rows)))
        # bounds are rounded
        low = (rough - 1e-9 * whole * self.before[:, -1].max())[:, None]
        groups = len(self.lists)
        for g in reversed(range(groups)):
            there, norm = self.lists[g]
            head = there[: np.searchsorted(norm, -reach, side="right")]
            lo, hi = self.cuts[g], self.cuts[g + 1]
            if len(head) == len(self.rows):
                score += a[:, lo:hi] @ self.rows[:, lo:hi].T
            elif len(head):
                score[:, head] += a[:, lo:hi] @ self.rows[head, lo:hi].T
            if g == groups // 2 and g and reach > 0:
                # what has no list above this group counts with its norm, as what comes below it does
                left = score + self._open(norms, reach, g) >= low
                if left.mean() < 0.05:
                    return self._exact(a, *np.nonzero(left), least)
        if reach > 0:
            score += self._open(norms, reach, 0)
        return self._exact(a, *np.nonzero(score >= low), least)

    def _open(self, norms, reach: float, g: int):
        """The most that the dimensions can add that haven't been added: those before group g, and those without the row in their list."""
        import numpy as np

        omitted = np.maximum((self.before < reach).sum(axis=1) - 1, g)
        return norms[:, omitted] * self.before[np.arange(len(self.rows)), omitted][None, :]

    def _exact(self, a, i, j, least):
        import numpy as np

        out = [self._some(a, i[k : k + (1 << 17)], j[k : k + (1 << 17)], least) for k in range(0, len(i), 1 << 17)]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (i, j, np.zeros(0))

    def _some(self, a, i, j, least):
        import numpy as np

        if a.size and self.rows.size and np.linalg.norm(a, axis=1).max() * self.before[:, -1].max() >= EXACT:
            score = np.array([sum(int(x) * int(y) for x, y in zip(a[p], self.rows[q], strict=True)) for p, q in zip(i, j, strict=True)], dtype=object)
        else:
            score = np.einsum("ij,ij->i", a[i], self.rows[j])
        good = np.asarray(score >= least[i], dtype=bool)
        return i[good], j[good], score[good]


class Windows:
    """What a block of anchors looks for: for each window its anchor, the ends of its scores, and how many rows fill it."""

    def __init__(self, anchors: dict, anchor: list[int], low: list, high: list, most: int, same: bool) -> None:
        self.anchors, self.anchor, self.low, self.high, self.most, self.same = anchors, anchor, low, high, most, same

    def search(self, batches: Iterator) -> Iterator:
        """(window, id, score): the best of these rows."""
        import numpy as np
        import pyarrow as pa

        if not self.anchor:
            return
        who = np.array(self.anchor)
        as_scores = lambda v: np.array(v, dtype=object if any(abs(x) > EXACT for x in v if abs(x) != float("inf")) else float)
        low, high = as_scores(self.low), as_scores(self.high)
        used = np.unique(who)
        place = np.searchsorted(used, who)
        first = np.concatenate((np.flatnonzero(np.diff(place, prepend=-1)), [len(who)]))
        ids, labels = self.anchors["id"][used], self.anchors["label"][used]
        vectors = [self.anchors["q"][k] for k in used]
        pool: list[tuple] = []
        asked = matrix(vectors)

        def best() -> list[tuple]:
            if not pool:
                return []
            w, i, s = (np.concatenate(x) for x in zip(*pool, strict=True))
            order = np.lexsort((i, -s, w)) if s.dtype != object else np.array(sorted(range(len(w)), key=lambda k: (w[k], -s[k], i[k])), dtype=np.int64)
            w, i, s = w[order], i[order], s[order]
            begin = np.flatnonzero(np.diff(w, prepend=-1))
            nth = np.arange(len(w)) - np.repeat(begin, np.diff(np.append(begin, len(w))))
            last = nth == self.most - 1
            low[w[last]] = np.maximum(low[w[last]], s[last])
            keep = nth < self.most
            return [(w[keep], i[keep], s[keep])]

        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                row_id, row_label = part.column(0).to_numpy(), part.column(1).to_numpy()
                rows = matrix(part.column(2).to_pylist(), max(asked.shape[1], 1))
                index = Index(rows)
                asked = asked if asked.shape[1] == rows.shape[1] else matrix(vectors, rows.shape[1])
                least = np.minimum.reduceat(low, first[:-1]).astype(object if low.dtype == object else float)
                with np.errstate(divide="ignore", invalid="ignore"):
                    steep = np.argsort(-np.nan_to_num(least.astype(float) / np.linalg.norm(asked, axis=1), nan=-np.inf), kind="stable")
                for tile in np.array_split(steep, len(steep) // TILE + 1):
                    a, r, s = index.pairs(asked[tile], least[tile] if low.dtype == object else least[tile].astype(float))
                    a = tile[a]
                    fits = ((row_label[r] == labels[a]) == self.same) & (row_id[r] != ids[a])
                    a, r, s = a[fits], r[fits], s[fits]
                    slot = 0
                    while len(a):
                        w = first[a] + slot
                        there = w < first[a + 1]
                        a, r, s, w = a[there], r[there], s[there], w[there]
                        good = np.asarray((s >= low[w]) & (s <= high[w]), dtype=bool)
                        if good.any():
                            pool.append((w[good], row_id[r[good]], s[good]))
                        slot += 1
                    if sum(len(x[0]) for x in pool) > POOL:
                        pool = best()
                        least = np.minimum.reduceat(low, first[:-1])
        for w, i, s in best():
            as_long = [max(-(1 << 63), min(int(x), (1 << 63) - 1)) for x in s]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(i, pa.int64()), pa.array(as_long, pa.int64())], ["w", "id", "score"])


def found(rows: DataFrame, windows: Windows) -> DataFrame:
    """(w, id, score, rank): the best rows of each window over all tasks, one round."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)
    best = rows.select("vec_id", "label", "q").mapInArrow(lambda batches: shared.value.search(batches), "w long, id long, score long")
    order = Window.partitionBy("w").orderBy(F.desc("score"), "id")
    return checkpoint(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= windows.most))


def positives(rows: DataFrame, anchors: dict, count: int, mean: float) -> list[tuple[int, int, int]]:
    """(anchor's place, id, score) of the best ``count`` rows of the same label, for one block of anchors."""
    import numpy as np

    norms = [float(np.linalg.norm(np.frombuffer(q, dtype="<f8"))) for q in anchors["q"]]
    todo, out = list(range(len(norms))), []
    for share in POSITIVE_ROUNDS:
        low = [float("-inf") if share is None else share * norms[k] * mean for k in todo]
        got = [(todo[r.w], r.id, r.score) for r in found(rows, Windows(anchors, todo, low, [float("inf")] * len(todo), count, True)).select("w", "id", "score").collect()]
        seen = np.bincount([k for k, _, _ in got], minlength=len(norms)) if got else np.zeros(len(norms), dtype=int)
        full = {k for k in todo if seen[k] >= count or share is None}
        out += [x for x in got if x[0] in full]
        todo = [k for k in todo if k not in full]
        if not todo:
            break
    return sorted(out, key=lambda x: (x[0], -x[2], x[1]))


def hard_negatives(rows: DataFrame, anchor: Column, count: int = 5, most: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """For the anchors (rows where ``anchor`` holds) and each of their ``count`` best positives, the best ``most`` rows of
    another label with low <= 100 * score / positive score <= high: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    import numpy as np

    spark = rows.sparkSession
    items = checkpoint(quantised(rows, scale).dropDuplicates(["vec_id", "label", "q"]))
    asked = items.where(anchor)
    n, longest = asked.agg(F.count(F.lit(1)), F.max(F.length("q"))).first()
    mean = items.agg(F.coalesce(F.avg("norm"), F.lit(0.0))).first()[0]
    blocks = -(-n * max(longest or 0, 64) // ANCHOR_BYTES)
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(blocks)) == block).select("vec_id", "label", "q").collect()
        if not part:
            continue
        anchors = {"id": np.array([r.vec_id for r in part]), "label": np.array([r.label for r in part]), "q": [bytes(r.q) for r in part]}
        best = positives(items, anchors, count, mean)
        # a window needs a positive score of at least zero
        todo = [(k, i, s, -(-low * s // 100), high * s // 100) for k, i, s in best if s >= 0]
        todo = [x for x in todo if x[3] <= x[4]]
        for share in NEGATIVE_ROUNDS:
            if not todo:
                break
            floor = [b if share == 1 else max(b, int(c - share * (c - b))) for _, _, _, b, c in todo]
            round_ = found(items, Windows(anchors, [x[0] for x in todo], floor, [x[4] for x in todo], most, False))
            full = {r.w for r in round_.where(F.col("rank") == most).select("w").collect()} if share < 1 else set(range(len(todo)))
            named = spark.createDataFrame([(w, int(anchors["id"][x[0]]), x[1], x[2]) for w, x in enumerate(todo) if w in full], "w long, anchor_id long, positive_id long, positive_score long")
            out = out.unionByName(checkpoint(round_.join(F.broadcast(named), "w").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
            todo = [x for w, x in enumerate(todo) if w not in full]
    return out


def oracle() -> str:
    """DuckDB SQL: the anchors with all rows."""
    return """
with v as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding::double[], lambda x: floor(256 * x)) q from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select a.vec_id anchor_id, b.vec_id id, a.label = b.label same, list_dot_product(a.q, b.q)::bigint score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
pos as (select * from (select *, row_number() over (partition by anchor_id order by score desc, id) k from p where same) where k <= 5),
neg as (select pos.anchor_id, pos.id positive_id, p.id negative_id, pos.score positive_score, p.score negative_score,
  row_number() over (partition by pos.anchor_id, pos.id order by p.score desc, p.id) rank
  from pos join p on pos.anchor_id = p.anchor_id and not p.same where 50 * pos.score <= 100 * p.score and 100 * p.score <= 95 * pos.score)
select anchor_id, positive_id, rank::integer rank, negative_id, positive_score, negative_score from neg where rank <= 3"""
