from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from quernstone.llm.quality_model import calibration, features, labelled_sample, posteriors, weights
from quernstone.llm.queries import op3_quality_model


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, unseen = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = posteriors(docs, seen).join(unseen, "doc_id").collect()
    assert len(rows) > 1500
    clean = [r.kept for r in rows if r.quality and not r.toxic]
    toxic = [r.kept for r in rows if r.toxic]
    bad = [r.kept for r in rows if not r.quality]
    # a tenth of the toxic labels is on texts without a word that any other toxic text has
    assert sum(clean) / len(clean) > 0.97 and sum(toxic) / len(toxic) < 0.15 and sum(bad) / len(bad) < 0.2


def test_query_covers_all_documents(spark, sf):
    rows = op3_quality_model(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1 and 0 < r.path_quality < 1 for r in rows)


def test_sparse_sites_shrink_more(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(1200):
        site = "big_bad" if i < 300 else "big_good" if i < 600 else f"s{i % 40}" if i < 1190 else "tiny_bad"
        good = rng.random() < {"big_bad": 0.1, "big_good": 0.95}.get(site, 0.7) and site != "tiny_bad"
        words = ["fine", "prose", "about", "things"] if good else ["junk", "spam", "click", "here"]
        docs.append((i, " ".join(rng.choices(words + ["the", "of", "a", "b"], k=30)), "en", site))
        labels.append((i, int(good), 0))
    out = posteriors(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rate = {d[3]: r.path_quality for r, d in zip(out.orderBy("doc_id").collect(), docs, strict=True)}
    assert rate["big_bad"] < 0.25 and rate["big_good"] > 0.85
    raw = sum(lab[1] for d, lab in zip(docs, labels, strict=True) if d[3] == "big_bad") / 300
    # ten documents, all bad, move further towards the others than three hundred
    assert rate["tiny_bad"] > 0.04 and abs(rate["big_bad"] - raw) < rate["tiny_bad"] - 0.0


def test_calibration():
    rng = random.Random(1)
    x = [rng.gauss(0, 2) for _ in range(5000)]
    a, b = calibration([(v, int(rng.random() < 1 / (1 + math.exp(-(1.5 * v - 0.5))))) for v in x])
    assert abs(a - 1.5) < 0.15 and abs(b + 0.5) < 0.15
    assert calibration([]) == (0.0, 0.0) and calibration([(1.0, 1)] * 5)[0] == 0.0


def test_cases(spark):
    schema = "doc_id long, text string, lang string, source string, site int, kept string, n int"
    rows = [(1, None, None, None), (2, "", "en", None), (3, "w " * 200_000, None, "a"), (3, "w " * 200_000, None, "a"), (None, "x", "en", "a")]
    docs = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in posteriors(docs, none).collect()] == [True] * 5
    one = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, 1)], none.schema)
    assert posteriors(docs, one).count() == 5
    assert posteriors(docs.limit(0), one).count() == 0


def brute(spark, docs: list[tuple], labels: list[tuple]) -> dict[int, tuple[float, ...]]:
    """The hierarchy in plain Python: (p_quality, p_toxic, path_quality, path_toxic) by doc_id, from the same evidence."""
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    sample = labelled_sample(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    by = weights(sample)
    held = [(sum(by[f][k] for f in features(r.text.encode()) if f in by), int((r.toxic if k else r.quality) > 0), k) for r in sample.where("fold = 2").collect() for k in (0, 1)]
    out: dict[int, list[float]] = {i: [0.0] * 4 for i, *_ in docs}
    for k in (0, 1):
        slope, start = calibration([(s, y) for s, y, which in held if which == k])
        odds = {i: slope * max(-30.0, min(30.0, sum(by[f][k] for f in features((t or "").encode()) if f in by))) + start for i, t, _, _ in docs}
        p = {i: 1 / (1 + math.exp(-x)) for i, x in odds.items()}
        path_of = {i: (s or "?", f"{s or '?'}/{g or '?'}") for i, _, g, s in docs}
        m = min(max(sum(p.values()) / len(docs), 1e-4), 1 - 1e-4)

        def shrunk(level: int, prior):
            groups: dict[str, list[float]] = {}
            for i in p:
                groups.setdefault(path_of[i][level], []).append(p[i])
            rows = [(g, len(v), sum(v), prior(g)) for g, v in groups.items()]
            w = sum(min(n, 10_000) for _, n, _, _ in rows)
            noise = sum(min(n, 10_000) * q * (1 - q) / n for _, n, _, q in rows)
            spread = sum(min(n, 10_000) * (s / n - q) ** 2 for _, n, s, q in rows)
            size = sum(min(n, 10_000) * q * (1 - q) for _, n, _, q in rows) / w
            strength = min(max(size / max((spread - noise) / w, 1e-9) - 1, 2.0), 1e6)
            return {g: (s + strength * q) / (n + strength) for g, n, s, q in rows}

        site = shrunk(0, lambda g: m)
        path = shrunk(1, lambda g: site[g.rsplit("/", 1)[0]])
        for i, x in odds.items():
            rate = max(1e-4, min(1 - 1e-4, path[path_of[i][1]]))
            out[i][k] = 1 / (1 + math.exp(-(x - math.log(m / (1 - m)) + math.log(rate / (1 - rate)))))
            out[i][2 + k] = path[path_of[i][1]]
    return {i: tuple(v) for i, v in out.items()}


def test_equals_brute_force(spark):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(600):
        site = rng.choice(("a", "a", "a", "b", "c", None))
        good, toxic = rng.random() < {"a": 0.9, "b": 0.3}.get(site, 0.6), rng.random() < 0.2
        words = (["fine", "prose", "about"] if good else ["junk", "spam", "click"]) + (["vile", "slur"] if toxic else [])
        docs.append((i, None if i % 97 == 0 else " ".join(rng.choices(words + ["the", "of", "a", "b"], k=30)), rng.choice(("en", "fr", None)), site))
        labels.append((i, int(good), int(toxic)))
    want = brute(spark, docs, labels)
    got = posteriors(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(want)
    for r in got:
        assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for a, b in zip((r.p_quality, r.p_toxic, r.path_quality, r.path_toxic), want[r.doc_id], strict=True))
        assert r.kept == (r.p_quality >= 0.5 and r.p_toxic < 0.5)


def test_contradicting_copies_do_not_depend_on_partitions(spark):
    from quernstone.llm.quality_model import labelled_sample

    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(70)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(3, 70)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    got = [sorted(map(tuple, labelled_sample(docs.repartition(n), labels.repartition(n)).collect())) for n in (2, 3, 7)]
    assert got[0] == got[1] == got[2] and {r[0] for r in got[0]} == {3, 4, 5, 6, 7, 8, 9}
    assert all((r[2], r[3]) == (r[0] % 2, int(r[0] % 3 == 0)) for r in got[0])
