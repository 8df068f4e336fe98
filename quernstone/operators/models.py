"""Lag features, expanding-window folds and regression models of MLlib."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions.scalars import cyclic, iso_week, iso_year, week_start

from .graph import ordinal  # noqa: F401  (folds are cut from it)
from .panel import K, Keys
from .series import errors


def lags(df: DataFrame, columns: dict[str, int], lead: tuple[str, int] | None = None, k: Keys = K, dense: bool = False) -> DataFrame:
    """Values of earlier rows of the unit (by position in year and week), 1 to n each, and one later value as target; null for null units.

    With ``dense`` the lags count calendar weeks: absent weeks between a unit's first and last are filled in for the
    window (without values) and taken out again.
    """
    if dense:
        week = week_start(F.col(k.year), F.col(k.week))
        span = df.where(F.col(k.unit).isNotNull()).groupBy(k.unit).agg(F.min(week).alias("_a"), F.max(week).alias("_z"))
        grid = span.select(k.unit, F.explode(F.expr("sequence(_a, _z, interval 7 days)")).alias("_week"))
        grid = grid.select(k.unit, iso_year(F.col("_week")).cast(df.schema[k.year].dataType).alias(k.year), iso_week(F.col("_week")).cast(df.schema[k.week].dataType).alias(k.week))
        full = df.withColumn("_has", F.lit(True)).join(grid, [k.unit, k.year, k.week], "full")
        return lags(full, columns, lead, k).where("_has").drop("_has").select(*df.columns, *[f"{c}_lag_{i}" for c, n in columns.items() for i in range(1, n + 1)], *(["target"] if lead else []))
    w = Window.partitionBy(k.unit).orderBy(k.year, k.week)
    has = F.col(k.unit).isNotNull()
    new = {f"{c}_lag_{i}": F.when(has, F.lag(c, i).over(w)) for c, n in columns.items() for i in range(1, n + 1)}
    if lead:
        new["target"] = F.when(has, F.lead(lead[0], lead[1]).over(w))
    return df.withColumns(new)


def feature_matrix(panel: DataFrame, category: str, climate: list[str], static: list[str], case_lags: int = 8, climate_lags: int = 4, horizon: int = 4, k: Keys = K) -> tuple[DataFrame, list[str]]:
    """Rows of one category with lags, cyclic week, the static columns that exist and the target; incomplete rows dropped."""
    one = panel.where(F.col(k.category) == category)
    out = lags(one, {k.cases: case_lags} | dict.fromkeys(climate, climate_lags), (k.cases, horizon), k)
    sin, cos = cyclic(F.col(k.week))
    out = out.withColumns({"week_sin": sin, "week_cos": cos})
    names = [f"{k.cases}_lag_{i}" for i in range(1, case_lags + 1)] + [f"{c}_lag_{i}" for c in climate for i in range(1, climate_lags + 1)] + ["week_sin", "week_cos"] + [c for c in static if c in panel.columns]
    return out.dropna(subset=[*names, "target"]), names


def stratified_cap(df: DataFrame, by: str, keys: list[str], over: int = 20_000, cap: int = 1700, seed: int = 42) -> DataFrame:
    """All rows, or if there are over ``over``, ``cap`` of each stratum at most, chosen by a hash of the keys."""
    if df.count() <= over:
        return df
    w = Window.partitionBy(by).orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def folds(df: DataFrame, n: int, count: int = 5) -> DataFrame:
    """Adds ``fold``: 0 is only trained on, fold i tests what all earlier folds train; the ordinal's order (time, or unit first) decides."""
    t = max(1, n // (count + 1))
    return df.withColumn("fold", F.greatest(F.lit(0), F.floor((F.col("ordinal") - (n - count * t)) / F.lit(t)) + 1).cast("int"))


def estimator(kind: str, seed: int = 42, **more):
    if kind == "linear":
        return LinearRegression(solver="normal", regParam=0.0, **more)
    if kind == "forest":
        return RandomForestRegressor(**({"numTrees": 150, "maxDepth": 10, "minInstancesPerNode": 5, "featureSubsetStrategy": "all", "seed": seed} | more))
    # MLlib's trees follow the gradient of the squared error, twice the residual: its step is half the learning rate of 0.07
    return GBTRegressor(**({"maxIter": 200, "maxDepth": 6, "stepSize": 0.035, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": seed} | more))


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df.withColumn("label", F.col("target").cast("double")))


def side_by_side(spark: SparkSession, tasks: list, at_once: int) -> list:
    """The results of functions without arguments, run in threads of the driver: their Spark jobs share the executors."""
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]]


def cross_validate(df: DataFrame, kind: str, count: int = 5, at_once: int = 5, **more) -> DataFrame:
    """(fold, rmse, mae, r2) of an assembled frame with ``fold``; a fresh estimator for each fold, ``at_once`` of them fitted side by side."""
    sizes = {r.fold: r["count"] for r in df.groupBy("fold").count().collect()}  # a row per fold
    used = [i for i in range(1, count + 1) if sizes.get(i) and sum(n for f, n in sizes.items() if f < i)]

    def fold(i: int):
        model = estimator(kind, **more).fit(df.where(F.col("fold") < i))
        return errors(model.transform(df.where(F.col("fold") == i)), "label", "prediction").withColumn("fold", F.lit(i)).first()

    rows = side_by_side(df.sparkSession, [lambda i=i: fold(i) for i in used], at_once)
    return df.sparkSession.createDataFrame([(r.rmse, r.mae, r.r2, r.fold) for r in rows], "rmse double, mae double, r2 double, fold int")


def summary(cv: DataFrame, model: str) -> DataFrame:
    """Mean and population deviation over folds, also as text."""
    stats = cv.agg(*[f(c).alias(f"{c}_{n}") for c in ("rmse", "mae", "r2") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    text = [F.format_string("%.3f ± %.3f", f"{c}_mean", f"{c}_std").alias(f"{c}_text") for c in ("rmse", "mae", "r2")]
    return stats.select(F.lit(model).alias("model"), "*", *text)


def importances(model: Model, features: list[str], spark, top: int = 20) -> DataFrame:
    rows = list(zip(features, map(float, model.featureImportances.toArray()), strict=True))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def learning_curve(df: DataFrame, kind: str, last: int = 5, shares: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 1.0), at_once: int = 5, **own) -> DataFrame:
    """(n_train, rmse_train, rmse_test, r2_train, r2_test): the first part of the last fold's training rows, parts under 50 rows skipped."""
    train, test = df.where(F.col("fold") < last), df.where(F.col("fold") == last)
    n = train.count()
    more = {"minInstancesPerNode": 1} if kind == "forest" else {"stepSize": 0.025, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"} if kind == "boosted" else {}

    def part(m: int) -> tuple:
        rows = train.where(F.col("ordinal") < m)
        model = estimator(kind, **(more | own)).fit(rows)
        a, b = (errors(model.transform(x), "label", "prediction").first() for x in (rows, test))
        return a.rmse, a.r2, b.rmse, b.r2, m

    found = side_by_side(df.sparkSession, [lambda m=m: part(m) for m in (int(n * s) for s in shares) if m >= 50], at_once)
    return df.sparkSession.createDataFrame(found, "rmse_train double, r2_train double, rmse_test double, r2_test double, n_train long")
