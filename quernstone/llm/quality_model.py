"""Operator 3, quality classification by hierarchical empirical Bayes.

Document evidence: texts become sets of hashed features (words, and levels of the counts that quality rules use).
On a bounded sample of labelled rows, features get log odds for good quality and for toxicity (naive Bayes over the
features that tell the classes apart), and the sums are calibrated on held-out labelled rows.

Hierarchy: all documents' evidence is aggregated by site (source) and path (source and language). Beta priors are
fitted by moments, the sites' spread around the corpus and the paths' around their site; each site's rate is shrunk
towards the corpus, each path's towards its site, the sparser the more. A document's posterior joins the path's rate
as prior odds with its own evidence; it is kept if it is probably good and probably not toxic.

Parameters with a bound: LABELLED rows to fit on, FEATURES weights. All counts by group are over all documents.

Cases: null text counts as empty (length features only); null source or lang are a site or path of their own; without
labels of both classes the evidence is nil and everything is kept; repeated rows get equal results; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpoint, salted_join
from .quality_rules import NAMES, measure

#: Labelled rows that the evidence is fitted on, at most.
LABELLED = 20_000
#: Weights that the evidence has, at most, for each of the two questions.
FEATURES = 4096
BUCKETS = 1 << 20
STRIP = b".,;:!?\"'()[]{}#*$%&|<>-_=+~/"
LEVELS = (0.001, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)


def features(data: bytes) -> set[int]:
    """Hashed words, stripped of marks and in lower case, and levels of the shape counts."""
    out = {crc32(w.strip(STRIP)) % BUCKETS for w in set(data.lower().split())}
    counts = dict(zip(NAMES, measure(data), strict=True))
    n = counts["n_words"]
    out.add(crc32(b"~words%d" % min(n, 4096).bit_length()) % BUCKETS)
    for name in ("n_symbols", "n_repeat_words", "n_upper_words", "n_plain_words", "n_stop_words", "dup_line_words"):
        share = counts[name] / n if n else 0
        out.add(crc32(b"~%s%d" % (name.encode(), sum(share >= x for x in LEVELS))) % BUCKETS)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, quality, toxic, fold): LABELLED rows at most, chosen by hash; fold 2 is held out. Of copies of a text with labels, which may
    contradict each other, the row of the smallest doc_id stands for all, however the table is dealt."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    n = known.count()
    dial = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))
    chosen = known.where(dial < int((1 << 30) * min(1.0, 0.95 * LABELLED / max(n, 1))))
    # bounded by LABELLED
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # copies of a text would count its words several times: the smallest doc_id's labels hold for them
    first = texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min(F.struct("doc_id", "quality", "toxic")).alias("first"))
    return first.select("first.doc_id", "text", "first.quality", "first.toxic").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).cast("int"))


def weights(sample: DataFrame) -> dict[int, tuple[float, float]]:
    """Log odds (quality, toxic) by feature, from the sample's folds 0 and 1."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in blocks(batches, 0):
            counts: dict[int, list[int]] = {}
            for text, good, toxic in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for f in features(text):
                    c = counts.setdefault(f, [0, 0, 0])
                    c[0] += 1
                    c[1] += good
                    c[2] += toxic
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in range(3))], ["f", "n", "good", "toxic"])

    train = sample.where("fold < 2").select(F.col("text").cast("binary").alias("text"), (F.col("quality") > 0).cast("int").alias("g"), (F.col("toxic") > 0).cast("int").alias("t"))
    size, good, toxic = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("g"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    counts = train.mapInArrow(run, "f int, n long, good long, toxic long").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    counts = checkpoint(counts.where("n >= 3"))
    out: dict[int, tuple[float, float]] = {}
    for k, (column, total) in enumerate((("good", good), ("toxic", toxic))):
        if not 0 < total < size:
            continue
        p = total / size
        x = F.col(column)
        z = (x - F.col("n") * p) / F.sqrt(F.col("n") * (p * (1 - p)) * (1 - F.col("n") / (size + 1.0)))
        odds = F.log(((x + 0.5) / (total + 1.0)) / ((F.col("n") - x + 0.5) / (size - total + 1.0)))
        best = counts.where((F.abs(z) > 6) & (F.abs(odds) >= 1)).orderBy(F.abs(z).desc(), "f").select("f", odds.alias("w")).limit(FEATURES)
        for r in best.collect():
            a = list(out.get(r.f, (0.0, 0.0)))
            a[k] = r.w
            out[r.f] = (a[0], a[1])
    return out


def scored(docs: DataFrame, by: dict[int, tuple[float, float]], keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs and the evidence sums s_good and s_toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(by)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = sent.value
        names = {f for f in table}
        for b in blocks(batches, len(keep)):
            good, toxic = [], []
            for text in b.column(len(keep)).to_pylist():
                hits = [table[f] for f in names & features(text)]
                good.append(sum(h[0] for h in hits))
                toxic.append(sum(h[1] for h in hits))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(good, pa.float64()), pa.array(toxic, pa.float64())], [*keep, "s_good", "s_toxic"])

    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"{schema}, s_good double, s_toxic double")


def calibration(pairs: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope and intercept of a ridge logistic fit of label on score; (0, prior odds) if one class is missing."""
    import numpy as np

    if not pairs:
        return 0.0, 0.0
    x, y = (np.array(c, dtype=float) for c in zip(*pairs, strict=True))
    x = np.clip(x, -30, 30)
    base = (y.sum() + 1) / (len(y) + 2)
    if y.min() == y.max():
        return 0.0, math.log(base / (1 - base))
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
    ridge, centre = np.diag([4.0, 0.01]), np.array([0.5, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        grad = design.T @ (p - y) + ridge @ (beta - centre)
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, grad)
        beta = beta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def _strength(groups: DataFrame, rate: str, prior: str) -> float:
    """How many documents a prior counts as, by moments: the spread of group rates beyond their sampling noise."""
    n, p, m = F.col("n").cast("double"), F.col(rate), F.col(prior)
    # a group counts up to 10,000 documents, so that one giant doesn't fix the spread of all
    weight = F.least(n, F.lit(10_000.0))
    noise, spread, w = groups.agg(F.sum(weight * m * (1 - m) / n), F.sum(weight * (p - m) * (p - m)), F.sum(weight)).first()
    level = groups.agg(F.sum(weight * m * (1 - m)) / F.sum(weight)).first()[0]
    if not w:
        return 1000.0
    between = max((spread - noise) / w, 1e-9)
    return float(min(max(level / between - 1, 2.0), 1e6))


def posteriors(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, p_quality, p_toxic, the path's shrunk rates, kept."""
    sample = checkpoint(labelled_sample(docs, labels))
    by = weights(sample)
    held = scored(sample.where("fold = 2"), by, ["quality", "toxic"]).collect()
    slope_g, start_g = calibration([(r.s_good, int(r.quality > 0)) for r in held])
    slope_t, start_t = calibration([(r.s_toxic, int(r.toxic > 0)) for r in held])
    if not by:
        start_g, start_t = 3.0, -3.0
    site = F.coalesce(F.col("source").cast("string"), F.lit("?"))
    path = F.concat_ws("/", site, F.coalesce(F.col("lang").cast("string"), F.lit("?")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), site.alias("site"), path.alias("path"), F.col("text"))
    rows = scored(rows, by, ["doc_id", "site", "path"])
    cut = lambda c: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(c)))
    rows = rows.select("doc_id", "site", "path", (slope_g * cut("s_good") + start_g).alias("l_good"), (slope_t * cut("s_toxic") + start_t).alias("l_toxic"))
    rows = checkpoint(rows)
    p = lambda c: 1 / (1 + F.exp(-F.col(c)))
    paths = rows.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p("l_good")).alias("good"), F.sum(p("l_toxic")).alias("toxic"))
    paths = checkpoint(paths)
    total, good, toxic = paths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("good"), F.sum("toxic")).first()
    if not total:
        return rows.select("doc_id", *(F.lit(0.0).alias(c) for c in ("p_quality", "p_toxic", "path_quality", "path_toxic")), F.lit(True).alias("kept"))
    sites = paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    shrunk = sites
    for c, all_of in (("good", good), ("toxic", toxic)):
        m = min(max(all_of / total, 1e-4), 1 - 1e-4)
        k = _strength(sites.withColumn("_m", F.lit(m)).withColumn("_r", F.col(c) / F.col("n")), "_r", "_m")
        shrunk = shrunk.withColumn(f"site_{c}", (F.col(c) + F.lit(k * m)) / (F.col("n") + F.lit(k)))
    shrunk = checkpoint(shrunk.select("site", "site_good", "site_toxic"))
    joined = checkpoint(paths.join(shrunk, "site"))
    tall = joined
    for c in ("good", "toxic"):
        k = _strength(joined.withColumn("_r", F.col(c) / F.col("n")), "_r", f"site_{c}")
        tall = tall.withColumn(f"path_{c}", (F.col(c) + F.lit(k) * F.col(f"site_{c}")) / (F.col("n") + F.lit(k)))
    prior = checkpoint(tall.select("path", "n", "path_good", "path_toxic"))
    if prior.count() * 96 <= 48 << 20:
        out = rows.join(F.broadcast(prior.drop("n")), "path")
    else:
        out = salted_join(rows, prior, "path", "n", F.col("doc_id"), total).drop("n")
    for c, all_of in (("good", good), ("toxic", toxic)):
        m = min(max(all_of / total, 1e-4), 1 - 1e-4)
        rate = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col(f"path_{c}")))
        odds = F.col(f"l_{c}") - F.lit(math.log(m / (1 - m))) + F.log(rate / (1 - rate))
        out = out.withColumn(f"p_{c}", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", F.col("p_good").alias("p_quality"), "p_toxic", F.col("path_good").alias("path_quality"), "path_toxic", ((F.col("p_good") >= threshold) & (F.col("p_toxic") < threshold)).alias("kept"))
