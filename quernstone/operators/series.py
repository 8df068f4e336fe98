"""Weekly series: spine, gap filling, decomposition, forecast and error metrics; any number of series at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spine(series: DataFrame, key: str, date: str) -> DataFrame:
    """Every Monday between a series' first and last one; values of absent weeks are null."""
    span = series.groupBy(key).agg(F.min(date).alias("a"), F.max(date).alias("z"))
    weeks = span.select(key, F.explode(F.sequence("a", "z", F.expr("interval 7 day"))).alias(date))
    return weeks.join(series, [key, date], "left")


def fill_gaps(weeks: DataFrame, key: str, date: str, value: str, limit: int = 3) -> DataFrame:
    """Linear in time, at most ``limit`` points into a gap, the rest zero."""
    w = Window.partitionBy(key).orderBy(date)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(date).alias("d"), F.col(value).cast("double").alias("v")))
    out = weeks.withColumns({"_a": F.last(known, True).over(before), "_z": F.first(known, True).over(after), "_i": F.row_number().over(w)})
    out = out.withColumn("_p", F.col("_i") - F.max(F.when(F.col(value).isNotNull(), F.col("_i"))).over(before))
    part = F.date_diff(F.col(date), F.col("_a.d")) / F.date_diff(F.col("_z.d"), F.col("_a.d"))
    line = F.when((F.col("_p") <= limit) & F.col("_z").isNotNull(), F.col("_a.v") + (F.col("_z.v") - F.col("_a.v")) * part).when(F.col("_p") <= limit, F.col("_a.v"))
    return out.withColumn(value, F.coalesce(F.col(value).cast("double"), line, F.lit(0.0))).drop("_a", "_z", "_i", "_p")


def stl(series: DataFrame, key: str, date: str, value: str, period: int = 52, robust_rounds: int = 15, least: int | None = None) -> DataFrame:
    """(key, date, value, trend, seasonal, resid): decomposition by loess, one task per series; short or empty series are left out."""
    least = least or 2 * period
    kinds = {f.name: f.dataType.simpleString() for f in series.select(key, date).schema}

    def run(pdf):
        from quernstone.operators.smooth import decompose

        pdf = pdf.sort_values("date")
        y = pdf["value"].to_numpy(float)
        if len(y) < least or not abs(y).sum():
            return pdf.iloc[:0].assign(trend=0.0, seasonal=0.0, resid=0.0)
        trend, seasonal = decompose(y, period, robust_rounds)
        return pdf.assign(trend=trend, seasonal=seasonal, resid=y - trend - seasonal)

    rows = series.select(F.col(key).alias("key"), F.col(date).alias("date"), F.col(value).cast("double").alias("value"))
    out = rows.groupBy("key").applyInPandas(run, f"key {kinds[key]}, date {kinds[date]}, value double, trend double, seasonal double, resid double")
    return out.withColumnsRenamed({"key": key, "date": date})


def seasonal_strength(parts: DataFrame, key: str) -> DataFrame:
    s = F.try_divide(F.var_pop("resid"), F.var_pop(F.col("seasonal") + F.col("resid")))
    return parts.groupBy(key).agg(F.greatest(F.lit(0.0), 1 - F.coalesce(s, F.lit(1.0))).alias("strength"), F.count(F.lit(1)).alias("n"))


def forecast(series: DataFrame, key: str, date: str, value: str, horizon: int = 52, harmonics: int = 6, knots: int = 5) -> DataFrame:
    """(key, date, yhat, lower, upper) for the weeks after each series' end: ridge regression of log1p on yearly Fourier terms and a piecewise line.

    The 95 % band adds three variances: of the noise, of the coefficients at the week's terms, and of bends of the trend to come, as often and as
    large as those in the series, which grows with the cube of the horizon.
    """
    kinds = {f.name: f.dataType.simpleString() for f in series.select(key, date).schema}

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("date")
        days = pd.to_datetime(pdf["date"])
        y = np.log1p(np.clip(pdf["value"].to_numpy(float), 0, None))
        start, span = days.iloc[0], max((days.iloc[-1] - days.iloc[0]).days, 7)
        ahead = pd.date_range(days.iloc[-1] + pd.Timedelta(days=7), periods=horizon, freq="7D")

        def design(d):
            t = np.asarray((pd.DatetimeIndex(d) - start).days, dtype=float)
            year = 2 * np.pi * np.asarray(pd.DatetimeIndex(d).dayofyear) / 365.25
            bends = [np.clip(t / span - k, 0, None) for k in np.linspace(0, 0.8, knots + 1)[1:]]
            return np.column_stack([np.ones_like(t), t / span, *bends, *[f(h * year) for h in range(1, harmonics + 1) for f in (np.sin, np.cos)]])

        a, x = design(days), design(ahead)
        ridge = np.diag([0.0, 0.0] + [5.0] * knots + [0.1] * (2 * harmonics))
        spread = np.linalg.inv(a.T @ a + ridge + 1e-9 * np.eye(a.shape[1]))
        beta = spread @ (a.T @ y)
        # as many coefficients as the ridge leaves free
        noise = float(np.sum((y - a @ beta) ** 2) / max(1.0, len(y) - np.trace(spread @ (a.T @ a))))
        later = np.arange(1, horizon + 1) * 7 / span
        bends = (knots / 0.8) * float(np.mean(beta[2 : 2 + knots] ** 2)) * later**3 / 3 if knots else 0.0
        wide = 1.96 * np.sqrt(noise * (1 + np.einsum("ij,jk,ik->i", x, spread, x)) + bends)
        mid = x @ beta
        up = lambda v: np.expm1(np.clip(v, 0, 50))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]] * horizon, "date": ahead.date, "yhat": up(mid), "lower": up(mid - wide), "upper": up(mid + wide)})

    rows = series.select(F.col(key).alias("key"), F.col(date).alias("date"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandas(run, f"key {kinds[key]}, date {kinds[date]}, yhat double, lower double, upper double").withColumnsRenamed({"key": key, "date": date})


def errors(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """RMSE, MAE and R2 (null for a constant target)."""
    a, e = F.col(actual).cast("double"), F.col(actual).cast("double") - F.col(predicted)
    return df.groupBy(*(by or [])).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.sum(e * e), F.var_pop(a) * F.count(a))).alias("r2"))


def coverage(df: DataFrame, actual: str, lower: str, upper: str, by: list[str] | None = None) -> DataFrame:
    """Share of the actual values that lie in their band, the mean width, and how many there are."""
    known = df.where(F.col(actual).isNotNull())
    return known.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(actual).between(F.col(lower), F.col(upper)).cast("double")).alias("covered"), F.avg(F.col(upper) - F.col(lower)).alias("width"))
