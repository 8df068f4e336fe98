from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.operators import graph, models, panel, series
from quernstone.plans.queries import QUERIES, SQL

TABLES = "/root/testdata/sf0.01"


def test_gap_of_five(spark):
    rows = [("a", f"2024-01-0{1}", 1.0), ("a", "2024-02-12", 13.0), ("b", "2024-01-01", 5.0), ("b", "2024-01-15", 9.0)]
    s = spark.createDataFrame(rows, "k string, d string, v double").withColumn("d", F.col("d").cast("date"))
    out = series.fill_gaps(series.spine(s, "k", "d"), "k", "d", "v").orderBy("k", "d").collect()
    assert [r.v for r in out if r.k == "a"] == [1.0, 3.0, 5.0, 7.0, 0.0, 0.0, 13.0] and [r.v for r in out if r.k == "b"] == [5.0, 7.0, 9.0]


def test_stl_separates_parts(spark):
    n = 260
    rng = np.random.default_rng(2)
    y = 50 + 0.1 * np.arange(n) + 10 * np.sin(2 * np.pi * np.arange(n) / 52) + rng.normal(0, 0.5, n)
    days = np.datetime64("2015-01-05") + 7 * np.arange(n)
    rows = [("a", str(d), float(v)) for d, v in zip(days, y, strict=True)] + [("zero", str(d), 0.0) for d in days] + [("short", str(d), 1.0) for d in days[:100]]
    parts = series.stl(spark.createDataFrame(rows, "k string, d string, v double").withColumn("d", F.col("d").cast("date")), "k", "d", "v").cache()
    got = parts.orderBy("d").collect()
    assert {r.k for r in got} == {"a"} and len(got) == n
    assert max(abs(r.v - r.trend - r.seasonal - r.resid) for r in (parts.withColumnRenamed("value", "v").collect())) < 1e-9
    assert series.seasonal_strength(parts, "k").first().strength > 0.95


def test_forecast_follows_the_year(spark):
    n = 300
    days = np.datetime64("2015-01-05") + 7 * np.arange(n)
    y = np.exp(3 + np.sin(2 * np.pi * np.arange(n) / 52.18))
    s = spark.createDataFrame([("a", str(d), float(v)) for d, v in zip(days[:248], y[:248], strict=True)], "k string, d string, v double").withColumn("d", F.col("d").cast("date"))
    got = series.forecast(s, "k", "d", "v").orderBy("d").collect()
    assert len(got) == 52 and all(r.lower <= r.yhat <= r.upper for r in got) and str(got[0].d) == str(days[248])
    assert np.corrcoef([r.yhat for r in got], y[248:300])[0, 1] > 0.97


def p_by_sums(r, n):
    """Student's distribution by its finite sums for whole degrees of freedom."""
    c = 1 - r * r
    if n % 2 == 0:
        return 1 - abs(r) * sum(math.exp(math.lgamma(k + 0.5) - math.lgamma(k + 1) - 0.5 * math.log(math.pi) + k * math.log(c)) for k in range((n - 2) // 2))
    return 1 - 2 / math.pi * (math.asin(abs(r)) + abs(r) * sum(math.sqrt(c) * math.exp(math.lgamma(k + 1) + math.log(math.sqrt(math.pi) / 2) - math.lgamma(k + 1.5) + k * math.log(c)) for k in range((n - 3) // 2)))


def test_p_values(spark):
    rows = [(r, n, p_by_sums(r, n)) for r in (0.02, -0.1, 0.5, 0.9, -0.999) for n in (3, 4, 10, 31, 100, 1001)] + [(0.01, 40_000, p_by_sums(0.01, 40_000))]
    df = spark.createDataFrame(rows, "r double, n long, want double").withColumn("p", panel.p_value(F.col("r"), F.col("n")))
    assert all(math.isclose(x.p, x.want, rel_tol=1e-9, abs_tol=1e-12) for x in df.collect())
    assert "Python" not in df._jdf.queryExecution().toString()
    odd = spark.createDataFrame([(None, 9), (0.5, None), (0.5, 2), (float("nan"), 9), (0.0, 9), (1.0, 9), (-1.0, 9)], "r double, n long")
    assert [x.p for x in odd.select(panel.p_value(F.col("r"), F.col("n")).alias("p")).collect()] == [None, None, None, None, 1.0, 0.0, 0.0]


def test_gate(spark, tmp_path):
    good = spark.createDataFrame([("a", True)], "rule string, passed boolean")
    assert panel.gate(good).count() == 1
    for bad in (False, None):
        with pytest.raises(ValueError, match="b"):
            panel.gate(good.unionByName(spark.createDataFrame([("b", bad)], good.schema)))
    rows = spark.createDataFrame([(u, "x", 5, 3.0 * u, None if u % 4 else 1.0) for u in range(40)], "unit int, cat string, cases long, incidence double, rain double")
    limits = {"units": 40, "max_incidence": 117.0, "principal_cases": 200, "fill": 0.25}
    want = {tuple(r) for r in panel.quality_report(rows, ["x"], "x", ["rain"], limits).collect()}
    got = panel.write_measured(rows, str(tmp_path / "p"), ["x"], "x", ["rain"], limits)
    assert {tuple(r) for r in got.collect()} == want and spark.read.parquet(str(tmp_path / "p")).count() == 40
    with pytest.raises(ValueError, match="fill_rain, units"):
        panel.write_measured(rows, str(tmp_path / "p"), ["x"], "x", ["rain"], limits | {"units": 41, "fill": 0.5})


def direct_loess(v, q, rho, at):
    """One place at a time, from all points."""
    n = len(v)
    out = []
    for t in at:
        d = sorted((abs(i - t), i) for i in range(n))
        h = d[min(q, n) - 1][0] + max(0, (q - n) // 2)
        w = [0.0 if abs(i - t) > 0.999 * h else 1.0 if abs(i - t) <= 0.001 * h else (1 - (abs(i - t) / h) ** 3) ** 3 for i in range(n)]
        w = [a * b for a, b in zip(w, rho, strict=True)]
        if not sum(w):
            out.append(v[min(max(int(t), 0), n - 1)])
            continue
        mean = sum(a * i for i, a in enumerate(w)) / sum(w)
        spread = sum(a * (i - mean) ** 2 for i, a in enumerate(w)) / sum(w)
        level = sum(a * b for a, b in zip(w, v, strict=True)) / sum(w)
        slope = sum(a * (i - mean) * b for i, (a, b) in enumerate(zip(w, v, strict=True))) / sum(w) / spread if math.sqrt(spread) > 0.001 * (n - 1) else 0.0
        out.append(level + slope * (t - mean))
    return out


def test_loess_equals_direct_fits(monkeypatch):
    from quernstone.operators import smooth

    rng = np.random.default_rng(8)
    for n, q in ((1, 7), (2, 7), (6, 7), (11, 7), (60, 13), (60, 101)):
        v = rng.normal(size=(3, n)) + np.arange(n)
        rho = np.where(rng.random((3, n)) < 0.3, 0.0, rng.random((3, n)))
        at = np.arange(-1.0, n + 1)
        for held in (1 << 21, 50):
            monkeypatch.setattr(smooth, "HELD", held)
            got = smooth.loess(v, q, rho, at)
            assert np.allclose(got, [direct_loess(v[i], q, rho[i], at) for i in range(3)], atol=1e-8)


def test_decomposition_equals_its_definition():
    from quernstone.operators.smooth import decompose

    rng = np.random.default_rng(9)
    p, n = 6, 45
    y = rng.normal(size=n) + 3 * np.sin(np.arange(n)) + np.where(np.arange(n) == 20, 30, 0)
    trend, rho = np.zeros(n), np.ones(n)
    for k in range(4):
        for _ in range(2):
            cycle = np.empty(n + 2 * p)
            for j in range(p):
                own = (y - trend)[j::p]
                cycle[j::p][: len(own) + 2] = direct_loess(own, 7, rho[j::p], np.arange(-1.0, len(own) + 1))
            low = cycle
            for m in (p, p, 3):
                low = np.convolve(low, np.ones(m) / m, "valid")
            part = cycle[p : p + n] - direct_loess(low, 7, np.ones(n), np.arange(float(n)))
            trend = np.array(direct_loess(y - part, 13, rho, np.arange(float(n))))
        if k < 3:
            r = abs(y - trend - part)
            u = r / (6 * np.median(r))
            rho = np.where(u <= 0.001, 1, np.where(u <= 0.999, (1 - u * u) ** 2, 0))
    got = decompose(y, p, 3)
    assert np.allclose(got[0], trend, atol=1e-6) and np.allclose(got[1], part, atol=1e-6)


def test_many_series_with_all_rounds(spark):
    weeks = spark.range(60 * 600).select((F.col("id") % 60).alias("k"), F.expr("date_add(date '2010-01-04', cast(7 * floor(id / 60) as int))").alias("d"), (10 + F.sin(F.floor(F.col("id") / 60) * 2 * math.pi / 52) * 5 + F.rand(1)).alias("v"))
    strength = series.seasonal_strength(series.stl(weeks, "k", "d", "v"), "k").collect()
    assert len(strength) == 60 and all(r.n == 600 and r.strength > 0.9 for r in strength)


def test_band_of_the_forecast(spark):
    n, m = 300, 52
    rng = np.random.default_rng(1)
    days = np.datetime64("2015-01-05") + 7 * np.arange(n)
    log = 4 + np.sin(2 * np.pi * np.arange(n) / 52.18) + 0.002 * np.arange(n) + rng.normal(0, 0.2, n)
    rows = [("a", str(d), float(np.expm1(v))) for d, v in zip(days, log, strict=True)]
    s = spark.createDataFrame(rows, "k string, d string, v double").withColumn("d", F.col("d").cast("date"))
    got = series.forecast(s.where(f"d < '{days[n - m]}'"), "k", "d", "v").orderBy("d").collect()
    width = [math.log1p(r.upper) - math.log1p(r.lower) for r in got]
    assert width == sorted(width) or np.all(np.diff(width) > -0.02 * np.mean(width))
    assert width[-1] > width[0] and 0.6 < width[0] < 1.5
    held = s.where(f"d >= '{days[n - m]}'").join(spark.createDataFrame(got), ["k", "d"])
    share = series.coverage(held, "v", "lower", "upper", ["k"]).first()
    assert share.n == m and share.covered >= 0.9

    # the same variances, by inverting the normal equations step by step
    t = np.arange(n - m) * 7.0
    span = t[-1]
    terms = lambda z, year: np.column_stack([np.ones_like(z), z / span, *[np.clip(z / span - c, 0, None) for c in np.linspace(0, 0.8, 6)[1:]], *[f(h * year) for h in range(1, 7) for f in (np.sin, np.cos)]])
    angle = lambda d: 2 * np.pi * np.array([int(str(np.datetime64(x, "D") - np.datetime64(str(x)[:4] + "-01-01", "D")).split()[0]) + 1 for x in d]) / 365.25
    a, x = terms(t, angle(days[: n - m])), terms(np.arange(n - m, n) * 7.0, angle(days[n - m :]))
    prior = np.diag([0.0, 0.0] + [5.0] * 5 + [0.1] * 12)
    beta = np.linalg.solve(a.T @ a + prior, a.T @ log[: n - m])
    free = n - m - np.trace(np.linalg.solve(a.T @ a + prior, a.T @ a))
    noise = ((log[: n - m] - a @ beta) ** 2).sum() / free
    h = np.arange(1, m + 1) * 7 / span
    want = [2 * 1.96 * math.sqrt(noise * (1 + v @ np.linalg.solve(a.T @ a + prior, v)) + 6.25 * (beta[2:7] ** 2).mean() * k**3 / 3) for v, k in zip(x, h, strict=True)]
    assert np.allclose(width, want, rtol=1e-4)


def test_polygons_with_holes(spark):
    def square(pid, ring, x, y, w, turned):
        at = [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
        return [(pid, ring, i, float(a), float(b)) for i, (a, b) in enumerate(at[::-1] if turned else at)]

    rows = []
    for pid, turns in enumerate([(0, 0, 0), (0, 1, 0), (1, 0, 1), (1, 1, 1)]):
        rows += square(pid, 0, 0, 0, 10, turns[0]) + square(pid, 1, 1, 1, 4, turns[1]) + square(pid, 2, 2, 2, 1, turns[2]) + square(pid, 3, 20, 0, 2, turns[0])
    rows += [(9, 0, 0, 1.0, 1.0), (9, 0, 1, 1.0, 1.0)] + [(8, 0, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (4, 0), (0, 3)])]
    df = spark.createDataFrame(rows, "id int, ring int, seq int, x double, y double")
    area = 100 - 16 + 1 + 4
    got = {r.id: r for r in panel.polygons(df).collect()}
    for pid in range(4):
        assert math.isclose(got[pid].area, area) and math.isclose(got[pid].cx, (100 * 5 - 16 * 3 + 2.5 + 4 * 21) / area) and math.isclose(got[pid].cy, (100 * 5 - 16 * 3 + 2.5 + 4 * 1) / area)
    assert got[9].area == 0 and got[9].cx is None and (got[8].area, got[8].cx, got[8].cy) == (6.0, pytest.approx(4 / 3), 1.0)
    assert {(r.id, r.ring) for r in panel.rings(df).where("hole").collect()} == {(i, 1) for i in range(4)}


def test_library_functions(spark, tmp_path):
    from quernstone.functions import scalars as S
    from quernstone.sources import files

    y = spark.createDataFrame([(1999,), (2021,), (2022,), (2030,), (None,)], "y int")
    assert [r.v for r in y.select(S.by_year(F.col("y"), {2022: "b", 2021: "a"}, "c").alias("v")).collect()] == ["a", "a", "b", "c", None]
    rows = [("f", "2015/03/01", "0000 UTC"), ("f", "2015-03-02", "13:00"), ("g", "01/03/2015", "900"), ("g", "31/12/2015", "1200"), (None, "x", "y")]
    got = files.timestamps(spark.createDataFrame(rows, "file string, d string, h string"), "d", "h", "file").collect()
    assert sorted(str(r["at"]) for r in got) == ["2015-03-01 00:00:00", "2015-03-01 09:00:00", "2015-03-02 13:00:00", "2015-12-31 12:00:00", "None"]
    names = files.split_names(spark.createDataFrame([("São Paulo (SP)",), ("Total",), ("X (ZZ)",), (None,)], "t string"), "t", ("SP", "RJ"))
    assert [(r.name, r.code) for r in names.collect()] == [("São Paulo", "SP")]


def test_panel_key_is_unique(spark):
    p = QUERIES["integrated_panel"](spark, TABLES)
    assert p.count() == p.select("yr", "wk", "unit", "cat").distinct().count()


def test_stratified_cap_is_bounded_and_repeatable(spark):
    df = spark.range(5000).withColumn("yr", F.col("id") % 4)
    a, b = (sorted(r.id for r in models.stratified_cap(df, "yr", ["id"], over=100, cap=50).collect()) for _ in range(2))
    assert a == b and len(a) == 200


#: Queries that fit forests or boosted trees at their full size, some minutes together: the operators are tested below with small ones.
LONG = {"rf_cv", "gbt_cv", "cv_summary", "rf_importance", "predicted_vs_actual", "learning_curve", "learning_curve_boosted"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - LONG))
def test_rows_only_queries(spark, name):
    rows = QUERIES[name](spark, TABLES).collect()
    assert rows
    if name in ("linreg_cv", "folds_by_unit"):
        assert [r.fold for r in sorted(rows, key=lambda r: r.fold)] == [1, 2, 3, 4, 5] and all(r.rmse >= r.mae > 0 for r in rows)


@pytest.mark.parametrize(("kind", "small"), [("forest", {"numTrees": 5, "maxDepth": 3}), ("boosted", {"maxIter": 3, "maxDepth": 3})])
def test_models_learn(spark, kind, small):
    """Errors by fold, a summary, a learning curve with R2 and importances, on a frame whose target follows one feature."""
    rows = [(i, float(i % 17), float(i * 7 % 5), float(3 * (i % 17)), i) for i in range(400)]
    df = graph.stored(models.assembled(models.folds(spark.createDataFrame(rows, "id long, a double, b double, target double, ordinal long"), 400), ["a", "b"]))
    cv = models.cross_validate(df, kind, **small).collect()
    assert sorted(r.fold for r in cv) == [1, 2, 3, 4, 5] and all(r.rmse >= r.mae > 0 and r.r2 > 0.5 for r in cv)
    table = models.summary(spark.createDataFrame(cv), kind).first()
    assert table.model == kind and "±" in table.r2_text
    curve = models.learning_curve(df, kind, **small).collect()
    assert {r.n_train for r in curve} == {83, 167, 250, 334} and all(r.r2_test > 0.5 for r in curve)
    best = models.importances(models.estimator(kind, **small).fit(df), ["a", "b"], spark).first()
    assert best.feature == "a"


class Stump:
    """A regression tree by exhaustive search, plain Python."""

    def __init__(self, x, y, depth):
        self.value, self.cut = sum(y) / len(y), None
        best = sum((v - self.value) ** 2 for v in y) - 1e-9
        for j in range(len(x[0])) if depth else ():
            for c in sorted({r[j] for r in x})[:-1]:
                parts = [[v for r, v in zip(x, y, strict=True) if (r[j] > c) == side] for side in (False, True)]
                loss = sum(sum((v - sum(p) / len(p)) ** 2 for v in p) for p in parts)
                if loss < best:
                    best, self.cut = loss, (j, c)
        if self.cut:
            j, c = self.cut
            self.below = [Stump(*zip(*[(r, v) for r, v in zip(x, y, strict=True) if (r[j] > c) == side], strict=True), depth - 1) for side in (False, True)]

    def __call__(self, r):
        return self.below[r[self.cut[0]] > self.cut[1]](r) if self.cut else self.value


def test_boosting_equals_a_plain_booster(spark):
    rng = np.random.default_rng(11)
    x = [tuple(map(float, r)) for r in rng.integers(0, 6, (400, 3))]
    y = [float(a * b + (c > 2) * 4 + e) for (a, b, c), e in zip(x, rng.normal(0, 0.3, 400), strict=True)]
    train, test = slice(0, 300), slice(300, 400)
    fits, left = [], y[train]
    for k in range(25):
        tree = Stump(x[train], left, 2)
        rate = 1.0 if k == 0 else 0.3
        fits.append((rate, tree))
        left = [v - rate * tree(r) for r, v in zip(x[train], left, strict=True)]
    want = [sum(rate * tree(r) for rate, tree in fits) for r in x[test]]
    df = models.assembled(spark.createDataFrame([(i, *r, v) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, target double"), ["a", "b", "c"])
    model = models.estimator("boosted", maxIter=25, maxDepth=2, stepSize=0.15, subsamplingRate=1.0, featureSubsetStrategy="all").fit(df.where("id < 300"))
    got = [r.prediction for r in model.transform(df.where("id >= 300")).orderBy("id").collect()]
    error = lambda p: float(np.sqrt(np.mean((np.array(p) - np.array(y[test])) ** 2)))
    assert np.corrcoef(got, want)[0, 1] > 0.995 and abs(error(got) / error(want) - 1) < 0.1


def test_long_queries_with_small_models(spark, monkeypatch):
    """What the queries of forests and boosted trees return, each by another way, with fewer and smaller trees."""
    whole = models.estimator
    small = {"linear": {}, "forest": {"numTrees": 4, "maxDepth": 3}, "boosted": {"maxIter": 3, "maxDepth": 2}}
    monkeypatch.setattr(models, "estimator", lambda kind, seed=42, **more: whole(kind, seed, **(more | small[kind])))
    cv = {k: {r.fold: r for r in QUERIES[q](spark, TABLES).collect()} for k, q in (("linear", "linreg_cv"), ("forest", "rf_cv"), ("boosted", "gbt_cv"))}
    assert all(sorted(v) == [1, 2, 3, 4, 5] and all(r.rmse >= r.mae > 0 for r in v.values()) for v in cv.values())
    for r in QUERIES["cv_summary"](spark, TABLES).collect():
        values = np.array([x.rmse for x in cv[r.model].values()])
        assert math.isclose(r.rmse_mean, values.mean(), rel_tol=1e-9) and math.isclose(r.rmse_std, values.std(), rel_tol=1e-6) and r.rmse_text == f"{values.mean():.3f} ± {values.std():.3f}"
    pairs = QUERIES["predicted_vs_actual"](spark, TABLES).collect()
    error = np.array([r.label - r.prediction for r in pairs])
    assert math.isclose(math.sqrt((error**2).mean()), cv["forest"][5].rmse, rel_tol=1e-9)
    top = QUERIES["rf_importance"](spark, TABLES).collect()
    assert len(top) == 20 and [r.importance for r in top] == sorted((r.importance for r in top), reverse=True) and 0 < sum(r.importance for r in top) <= 1 + 1e-9
    for name, kind in (("learning_curve", "forest"), ("learning_curve_boosted", "boosted")):
        curve = sorted(QUERIES[name](spark, TABLES).collect(), key=lambda r: r.n_train)
        assert len(curve) == 5 and all(r.rmse_train > 0 and r.rmse_test > 0 for r in curve) and curve[-1].n_train > 5 * curve[0].n_train, kind


def test_estimators_have_the_reference_size():
    forest, boosted = models.estimator("forest"), models.estimator("boosted")
    assert (forest.getNumTrees(), forest.getMaxDepth(), boosted.getMaxIter(), boosted.getMaxDepth()) == (150, 10, 200, 6)


def test_null_names_match_nothing(spark):
    left = spark.createDataFrame([(1, None, "SP"), (2, "São João", "SP"), (3, "Sao Joao", None), (4, "ﬁm ő", "RJ")], "id int, name string, uf string")
    dim = spark.createDataFrame([(10, None, "SP"), (20, "SAO JOAO", "SP"), (30, "fim o", "RJ"), (40, "x", None)], "code int, name string, uf string")
    assert {r.id: r.code for r in panel.name_match(left, dim, "name", "uf").collect()} == {1: None, 2: 20, 3: None, 4: 30}


def test_quantile_is_exact(spark):
    rng = np.random.default_rng(3)
    for values in (rng.integers(0, 9, 101).astype(float), rng.standard_normal(50), np.array([4.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for p in (0.0, 0.25, 0.75, 1.0):
            assert math.isclose(graph.quantile(df, "v", p).first().cut, float(np.quantile(values, p)))


def test_dense_lags_and_codes(spark):
    rows = [(1, 1997, 51, 5), (1, 1997, 52, 6), (1, 1998, 2, 7), (None, 1998, 1, 9)]
    out = models.lags(spark.createDataFrame(rows, "unit int, yr long, wk long, cases long"), {"cases": 2}, ("cases", 1), dense=True)
    got = {(r.unit, r.yr, r.wk): (r.cases_lag_1, r.cases_lag_2, r.target) for r in out.collect()}
    assert got == {(1, 1997, 51): (None, None, 6), (1, 1997, 52): (5, None, None), (1, 1998, 2): (None, 6, None), (None, 1998, 1): (None, None, None)}


def test_weekly_keeps_the_first_place(spark):
    rows = [("A", f"2024-01-0{d} 00:00:00", float(d), 10.0 + d if d > 1 else None) for d in (1, 2, 3)]
    readings = spark.createDataFrame(rows, "s string, t string, v double, lat double").withColumn("t", F.to_timestamp("t"))
    out = panel.weekly(panel.daily(readings, "s", "t", "v", ("lat",)), "s", place=("lat",)).collect()
    assert len(out) == 1 and out[0].lat == 12.0 and out[0].total == 6.0


def test_constant_covariates_have_no_correlation(spark):
    """The same units every week, in any order: their mean has no variance, so r is null, not one of rounding errors."""
    rng = np.random.default_rng(5)
    value = {u: float(v) for u, v in enumerate(rng.uniform(4000, 5000, 5))}
    rows = [("a", 2020 + w // 50, w % 50 + 1, u, int(rng.integers(1, 50)), value[u]) for w in range(100) for u in range(5)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    df = spark.createDataFrame(rows, "grp string, yr long, wk long, unit long, cases long, idx double").repartition(7)
    reg = panel.regional(df, ["idx"]).cache()
    assert reg.select("idx").distinct().count() == 1
    got = panel.lag_correlations(reg, ["idx"], "cases", [0], "grp", ["yr", "wk"]).collect()
    assert [(r.n, r.r) for r in got] == [(100, None)]


def test_lags_without_pairs_have_no_row(spark):
    """As in the SQL: three weeks have no pair at a lag of three or four."""
    reg = spark.createDataFrame([("a", 2020, w, 5 + w, 1.0 * w) for w in range(1, 4)], "grp string, yr long, wk long, cases long, rain double")
    got = panel.lag_correlations(reg, ["rain"], "cases", [1, 2, 3, 4], "grp", ["yr", "wk"]).collect()
    assert sorted((r.lag, r.n, r.r) for r in got) == [(1, 2, None), (2, 1, None)]
