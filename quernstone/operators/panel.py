"""The panel unit x ISO week x category and the tables around it. Keys and measures are column names."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quernstone.functions.scalars import iso_week, iso_year, name_key, rate

from .graph import ranks  # noqa: F401  (a table's operator, found by prefix sums there)


@dataclass(frozen=True)
class Keys:
    """Column names of a panel."""

    unit: str = "unit"
    group: str = "grp"
    category: str = "cat"
    year: str = "yr"
    week: str = "wk"
    cases: str = "cases"


K = Keys()


def beside(df: DataFrame, dim: DataFrame, on: list[str] | str, how: str = "left") -> DataFrame:
    """Join with a dimension: Spark broadcasts it if its bytes, as known to the plan or measured while it runs, are below the session's threshold."""
    return df.join(dim, on, how)


def valid_codes(df: DataFrame, code: str, codes: DataFrame | None) -> DataFrame:
    """Rows whose code is among ``codes`` (one column); everything if no codes are given."""
    return df if codes is None else df.join(codes.select(F.col(codes.columns[0]).alias(code)), code, "left_semi")


def with_iso_week(df: DataFrame, date: str, k: Keys = K) -> DataFrame:
    return df.withColumns({k.year: iso_year(F.col(date)), k.week: iso_week(F.col(date))})


def cases_by_week(cases: DataFrame, date: str, k: Keys = K) -> DataFrame:
    """Count per (year, week, unit, category) over all partitions at once, so the key is unique; null keys stay."""
    return with_iso_week(cases, date, k).groupBy(k.year, k.week, k.unit, k.category).agg(F.count(F.lit(1)).alias(k.cases))


def _list(keys: str | list[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def daily(readings: DataFrame, station: str | list[str], ts: str, value: str, place: tuple[str, ...] = ()) -> DataFrame:
    """Per station (one or several columns, such as latitude and longitude) and day: sum (nothing is 0), mean, max, min, the first reading's ``place`` columns; rows without time dropped."""
    v = F.col(value)
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in place]
    return readings.where(F.col(ts).isNotNull()).groupBy(*_list(station), F.to_date(ts).alias("day")).agg(*first, F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.avg(v).alias("mean"), F.max(v).alias("high"), F.min(v).alias("low"))


def weekly(days: DataFrame, station: str | list[str], k: Keys = K, place: tuple[str, ...] = ()) -> DataFrame:
    """Per station and ISO week: sum of sums, means of daily values, and of ``place`` columns (latitude and the like) the first day's."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("day"))).alias(c) for c in place]
    return with_iso_week(days, "day", k).groupBy(*_list(station), k.year, k.week).agg(*first, F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.avg("mean").alias("mean"), F.avg("high").alias("high"), F.avg("low").alias("low"))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by an order that leaves no ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def name_match(df: DataFrame, dim: DataFrame, name: str, area: str) -> DataFrame:
    """Left join on normalised name and area; both sides' columns, dim's columns null where nothing matches. A null name or area matches nothing."""
    key = lambda d: d.withColumns({"_name": name_key(F.col(name)), "_area": F.col(area)})
    right = first_by(key(dim).where("_name is not null and _area is not null"), ["_name", "_area"], F.col(name)).drop(name, area)
    return beside(key(df), right, ["_name", "_area"]).drop("_name", "_area")


def accounting(df: DataFrame, keep: Column, part: str) -> DataFrame:
    """Rows in, rows kept and per cent, per partition and (null) in total: one pass."""
    out = df.rollup(part).agg(F.count(F.lit(1)).alias("rows_in"), F.sum(keep.cast("long")).alias("rows_out"))
    return out.withColumn("pct", F.round(F.try_divide(100.0 * F.col("rows_out"), F.col("rows_in")), 2))


def nearest_station(units: DataFrame, stations: DataFrame) -> DataFrame:
    """(unit, station): nearest by degrees, ties by station id."""
    from .graph import nearest

    return nearest(units, stations, 1).select(F.col("src").alias("unit"), F.col("dst").alias("station"), "d2")


def integrate(cases: DataFrame, date: str, units: DataFrame, climate: DataFrame | None, statics: list[DataFrame], yearly: list[DataFrame], flag: str | None = None, flag_from: int = 0, area: str | None = None, people: str = "people", k: Keys = K) -> DataFrame:
    """The integrated panel in one plan: count, dimension, climate week, static and yearly tables, rates and density.

    Tables that are absent (None, not listed) drop out of the plan. Cases are counted before anything is joined.
    """
    out = beside(cases_by_week(cases, date, k), units, k.unit)
    if climate is not None:
        out = out.join(climate, [k.year, k.week, k.unit], "left")
    for s in statics:
        out = beside(out, s, k.unit)
    for y in yearly:
        out = beside(out, y, [k.unit, k.year])
    if people in out.columns:
        out = out.withColumn("incidence", rate(F.col(k.cases), F.col(people)))
        if area:
            out = out.withColumn("density", F.try_divide(F.col(people).cast("double"), F.col(area).cast("double")))
    if flag:
        out = out.withColumn(flag, F.when(F.col(k.year) < flag_from, F.lit(0)).otherwise(F.coalesce(F.col(flag), F.lit(0))).cast("byte"))
    return out


def pivot_sum(df: DataFrame, group: str, category: str, values: list[str], measure: str) -> DataFrame:
    """Group x category sums, zero where nothing is; null keys dropped; the values are named, so nothing is scanned for them."""
    return df.where(F.col(group).isNotNull() & F.col(category).isNotNull()).groupBy(group).pivot(category, values).agg(F.sum(measure)).na.fill(0)


def share_of_total(df: DataFrame, category: str, measure: str) -> DataFrame:
    sums = df.groupBy(category).agg(F.sum(measure).alias("total"))
    return sums.withColumn("pct", F.round(100.0 * F.col("total") / F.sum("total").over(Window.partitionBy()), 1))


def regional(panel: DataFrame, means: list[str], k: Keys = K) -> DataFrame:
    """Sum of cases and plain means of covariates per (group, year, week).

    Values are added up in order, a list of a group's units in one week, so that equal values have equal means wherever their
    rows come from: a covariate that is the same every week stays without variance.
    """

    def mean(m: str) -> Column:
        values = F.array_sort(F.collect_list(F.col(m).cast("double")))
        return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.count(m)).alias(m)

    return panel.where(F.col(k.group).isNotNull()).groupBy(k.group, k.year, k.week).agg(F.sum(k.cases).alias(k.cases), *map(mean, means))


def upper_quartile(df: DataFrame, measure: str, p: float = 0.75) -> DataFrame:
    """Rows at or over the exact interpolated quantile; nulls don't count."""
    from .graph import quantile

    cut = quantile(df, measure, p).select(F.col("cut").alias("_cut"))
    return df.join(F.broadcast(cut), F.col(measure) >= F.col("_cut")).drop("_cut")  # one row


def lag_correlations(df: DataFrame, variables: list[str], target: str, lags: list[int], group: str, order: list[str], least: int = 30) -> DataFrame:
    """(group, variable, lag, n, r): Pearson r of each variable, lagged by rows, with the target; null under ``least`` pairs.

    One window for all variables and lags, one aggregation; only pairs without nulls count. Without any pair there is no row.
    """
    w = Window.partitionBy(group).orderBy(*order)
    y = F.col(target).cast("double")
    pairs = [(v, n) for v in variables for n in lags]
    lagged = df.select(group, y.alias("y"), *[(F.lag(F.col(v).cast("double"), n).over(w) if n else F.col(v).cast("double")).alias(f"{v}__{n}") for v, n in pairs])
    long = lagged.select(group, "y", F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(n).alias("lag"), F.col(f"{v}__{n}").alias("x")) for v, n in pairs])).alias("p"))
    long = long.select(group, "p.variable", "p.lag", F.col("p.x").alias("x"), "y").where("x is not null and y is not null")
    r = F.try_divide(F.covar_pop("x", "y"), F.sqrt(F.var_pop("x") * F.var_pop("y")))
    return long.groupBy(group, "variable", "lag").agg(F.count("x").alias("n"), F.when(F.count("x") >= least, r).alias("r"))


# Coefficients of Lanczos' series for the gamma function with g = 7.
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function from one half on."""
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:]):
        series = series + c / (z + i)
    t = z + 6.5
    return F.lit(0.9189385332046727) + (z - 0.5) * F.log(t) - t + F.log(series)  # half of log(2 pi)


def p_value(r: Column, n: Column) -> Column:
    """Two-sided p of r under no correlation; null under three pairs.

    The incomplete beta function by its continued fraction, folded over as many terms as n asks for; all in the JVM.
    """
    a0, x0 = (n.cast("double") - 2) / 2, 1 - r.cast("double") * r.cast("double")
    flip = x0 >= (a0 + 1) / (a0 + 2.5)
    half = F.lit(0.5)
    args = F.struct(F.when(flip, half).otherwise(a0).alias("a"), F.when(flip, a0).otherwise(half).alias("b"), F.when(flip, 1 - x0).otherwise(x0).alias("x"), flip.alias("flip"), (50 + F.ceil(2 * F.sqrt(n.cast("double")))).cast("int").alias("terms"))

    def whole(s: Column) -> Column:
        a, b, x = s["a"], s["b"], s["x"]
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
        d = 1 / (1 - (a + b) * x / (a + 1))

        def step(at: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d1, c1 = 1 / (1 + even * at["d"]), 1 + even / at["c"]
            d2, c2 = 1 / (1 + odd * d1), 1 + odd / c1
            return F.struct(c2.alias("c"), d2.alias("d"), (at["h"] * d1 * c1 * d2 * c2).alias("h"))

        h = F.aggregate(F.sequence(F.lit(1), s["terms"]), F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")), step)["h"]
        return F.when(s["flip"], 1 - front * h / a).otherwise(front * h / a)

    p = F.transform(F.array(args), whole)[0]
    return F.when(r.isNull() | F.isnan(r.cast("double")) | n.isNull() | (n < 3), None).when(r == 0, 1.0).when(F.abs(r) >= 1, 0.0).otherwise(p)


def best_lags(correlations: DataFrame, group: str) -> DataFrame:
    """Per group and variable the lag of largest |r|, ties to the smaller; (0, 0.0) if no r is known."""
    w = Window.partitionBy(group, "variable").orderBy(F.abs("r").desc_nulls_last(), "lag")
    top = correlations.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return top.select(group, "variable", F.when(F.col("r").isNull(), 0).otherwise(F.col("lag")).cast("long").alias("lag"), F.coalesce("r", F.lit(0.0)).alias("r"), "n")


def rings(vertices: DataFrame) -> DataFrame:
    """(id, ring, hole, area, cx, cy) of rings given as (id, ring, seq, x, y) in plane units, in either orientation.

    A ring is a hole if an odd number of its polygon's other rings surround it: a horizontal ray from the middle of its first edge is
    cut by their edges. Only rings whose boxes hold that point are asked. Centroids are null for rings without area.
    """
    w = Window.partitionBy("id", "ring").orderBy("seq")
    back = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(back)) for c in ("x", "y"))
    edges = vertices.select("id", "ring", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumns({"nx": nx, "ny": ny}).withColumn("cross", F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))
    first = F.min(F.struct("seq", ((F.col("x") + F.col("nx")) / 2).alias("px"), ((F.col("y") + F.col("ny")) / 2).alias("py"))).alias("p")
    box = [f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("l", F.min), ("h", F.max))]
    sums = edges.groupBy("id", "ring").agg(F.sum("cross").alias("a2"), F.sum((F.col("x") + F.col("nx")) * F.col("cross")).alias("sx"), F.sum((F.col("y") + F.col("ny")) * F.col("cross")).alias("sy"), first, *box)
    asked = sums.select("id", F.col("ring").alias("inner"), "p.px", "p.py")
    inside = (F.col("inner") != F.col("ring")) & F.col("px").between(F.col("lx"), F.col("hx")) & F.col("py").between(F.col("ly"), F.col("hy"))
    pairs = asked.join(sums.select("id", "ring", "lx", "hx", "ly", "hy"), "id").where(inside).select("id", "ring", "inner", "px", "py")
    over = (F.col("y") > F.col("py")) != (F.col("ny") > F.col("py"))
    right = F.col("px") < (F.col("nx") - F.col("x")) * (F.col("py") - F.col("y")) / F.nullif(F.col("ny") - F.col("y"), F.lit(0.0)) + F.col("x")
    cut = pairs.join(edges.select("id", "ring", "x", "y", "nx", "ny"), ["id", "ring"]).where(over & right)
    around = cut.groupBy("id", "inner", "ring").agg((F.count(F.lit(1)) % 2).alias("odd")).groupBy("id", F.col("inner").alias("ring")).agg(F.sum("odd").alias("depth"))
    out = sums.join(around, ["id", "ring"], "left")
    return out.select("id", "ring", (F.coalesce("depth", F.lit(0)) % 2 == 1).alias("hole"), F.abs(F.col("a2") / 2).alias("area"), F.try_divide("sx", 3 * F.col("a2")).alias("cx"), F.try_divide("sy", 3 * F.col("a2")).alias("cy"))


def polygons(vertices: DataFrame) -> DataFrame:
    """(id, area, cx, cy) of polygons of any number of rings: holes take their area and moment away."""
    signed = F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))
    sums = rings(vertices).groupBy("id").agg(F.sum(signed).alias("area"), *[F.sum(signed * F.coalesce(c, F.lit(0.0))).alias(c) for c in ("cx", "cy")])
    return sums.select("id", "area", F.try_divide("cx", "area").alias("cx"), F.try_divide("cy", "area").alias("cy"))


def _measures(panel: DataFrame, units: Column, valid: list[str], principal: str, required: list[str], k: Keys) -> list[Column]:
    present = [c for c in required if c in panel.columns]
    return [
        units.cast("double").alias("units"), F.sum((~F.col(k.category).isin(*valid)).cast("double")).alias("invalid_labels"), F.coalesce(F.max("incidence"), F.lit(0.0)).alias("max_incidence"),
        F.sum(F.when(F.col(k.category) == principal, F.col(k.cases)).otherwise(0)).cast("double").alias("principal_cases"), *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"fill_{c}") for c in present],
    ]


def _judged(long: DataFrame, limits: dict[str, float]) -> DataFrame:
    passed = F.when(F.col("rule") == "units", F.col("value") >= limits["units"]).when(F.col("rule") == "invalid_labels", F.col("value") == 0).when(F.col("rule") == "max_incidence", F.col("value") <= limits["max_incidence"])
    return long.withColumn("passed", passed.when(F.col("rule") == "principal_cases", F.col("value") >= limits["principal_cases"]).otherwise(F.col("value") >= limits["fill"]))


def quality_report(panel: DataFrame, valid: list[str], principal: str, required: list[str], limits: dict[str, float], k: Keys = K) -> DataFrame:
    """(rule, value, passed): units, invalid labels, largest rate, total of the principal category, fill rates; one aggregation."""
    row = panel.agg(*_measures(panel, F.count_distinct(k.unit), valid, principal, required, k))
    return _judged(row.unpivot([], row.columns, "rule", "value"), limits)


def write_measured(panel: DataFrame, path: str, valid: list[str], principal: str, required: list[str], limits: dict[str, float], k: Keys = K, stop: bool = True) -> DataFrame:
    """Writes the panel and returns the report of its rules, measured while it was written: no second pass.

    With ``stop`` an error lists the rules that fail; what has been written then isn't to be published, so write to a staging path. Units are counted
    as a set, as large as the dimension of units.
    """
    seen = Observation("quality")
    panel.observe(seen, *_measures(panel, F.size(F.collect_set(k.unit)), valid, principal, required, k)).write.mode("overwrite").parquet(path)
    rows = [(name, None if v is None else float(v)) for name, v in seen.get.items()]
    report = _judged(panel.sparkSession.createDataFrame(rows, "rule string, value double"), limits)
    return gate(report) if stop else report


def gate(report: DataFrame) -> DataFrame:
    """The report, or an error that lists the rules that fail."""
    failed = [r.rule for r in report.where("not coalesce(passed, false)").collect()]  # a report has a row per rule
    if failed:
        raise ValueError("data quality rules failed: " + ", ".join(sorted(failed)))
    return report


def summed(columns: list[Column]) -> Column:
    return reduce(Column.__add__, columns)
