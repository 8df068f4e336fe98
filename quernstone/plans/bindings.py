"""The panel's roles bound to the test tables: which table and column plays which part. SQL holds the same for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.scalars import iso_week, iso_year
from quernstone.operators.panel import cases_by_week

PRINCIPAL = "1-URGENT"
CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def cases(self) -> DataFrame:
        """One row per case: unit, date, category."""
        o = self.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderpriority").alias("cat"))
        return o.join(self.customer.select("c_custkey", F.col("c_nationkey").alias("unit")), F.col("o_custkey") == F.col("c_custkey")).select("unit", "d", "cat")

    def counts(self) -> DataFrame:
        return cases_by_week(self.cases(), "d")

    def units(self) -> DataFrame:
        n = self.nation.select(F.col("n_nationkey").alias("unit"), F.col("n_name").alias("name"), "n_regionkey")
        return n.join(self.region, n.n_regionkey == F.col("r_regionkey"), "left").select("unit", "name", F.col("r_name").alias("grp"))

    def climate(self) -> DataFrame:
        s = self.supplier.select("s_suppkey", F.col("s_nationkey").alias("unit"))
        r = self.lineitem.select("l_suppkey", F.col("l_shipdate").cast("date").alias("d"), "l_quantity", "l_discount", "l_tax").join(s, F.col("l_suppkey") == s.s_suppkey)
        return r.groupBy(iso_year(F.col("d")).alias("yr"), iso_week(F.col("d")).alias("wk"), "unit").agg(F.sum("l_quantity").alias("rain"), F.avg("l_discount").alias("temp"), F.avg("l_tax").alias("humid"))

    def people(self) -> DataFrame:
        """People per unit and year: customers, the same every year that has cases."""
        n = self.customer.groupBy(F.col("c_nationkey").alias("unit")).agg(F.count(F.lit(1)).alias("people"))
        # a list of years, a few dozen at most by its kind, put to every unit
        years = self.orders.agg(F.array_sort(F.collect_set(iso_year(F.col("o_orderdate").cast("date")))).alias("years")).first()[0]
        return n.withColumn("yr", F.explode(F.array(*map(F.lit, years)).cast("array<long>")))

    def index(self) -> DataFrame:
        return self.customer.groupBy(F.col("c_nationkey").alias("unit")).agg(F.avg("c_acctbal").alias("idx"))

    def area(self) -> DataFrame:
        return self.supplier.groupBy(F.col("s_nationkey").alias("unit")).agg(F.count(F.lit(1)).alias("area"))

    def flags(self) -> DataFrame:
        """Only the ones are stored: units and years with a pending order from 1998 on."""
        o = self.orders.where("o_orderstatus = 'P'").select("o_custkey", iso_year(F.col("o_orderdate").cast("date")).alias("yr")).where("yr >= 1998")
        return o.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("unit"), "yr", F.lit(1).alias("flag")).distinct()

    def points(self) -> DataFrame:
        e = F.col("embedding")
        return self.embeddings.select(F.col("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), F.col("label").cast("double").alias("value"))

    def panel(self) -> DataFrame:
        from quernstone.operators.panel import integrate

        return integrate(self.cases(), "d", self.units(), self.climate(), [self.index(), self.area()], [self.people(), self.flags()], flag="flag", flag_from=1998, area="area")


# The same as SQL common table expressions.
CASES = "cases AS (SELECT c_nationkey AS unit, CAST(o_orderdate AS DATE) AS d, o_orderpriority AS cat FROM orders JOIN customer ON o_custkey = c_custkey)"
COUNTS = CASES + ", counts AS (SELECT CAST(isoyear(d) AS BIGINT) AS yr, CAST(week(d) AS BIGINT) AS wk, unit, cat, count(*) AS cases FROM cases GROUP BY ALL)"
UNITS = "units AS (SELECT n_nationkey AS unit, n_name AS name, r_name AS grp FROM nation LEFT JOIN region ON n_regionkey = r_regionkey)"
CLIMATE = "climate AS (SELECT CAST(isoyear(CAST(l_shipdate AS DATE)) AS BIGINT) AS yr, CAST(week(CAST(l_shipdate AS DATE)) AS BIGINT) AS wk, s_nationkey AS unit, sum(l_quantity) AS rain, avg(l_discount) AS temp, avg(l_tax) AS humid FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"
PEOPLE = "people AS (SELECT c_nationkey AS unit, yr, n AS people FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1), (SELECT DISTINCT CAST(isoyear(CAST(o_orderdate AS DATE)) AS BIGINT) AS yr FROM orders))"
INDEX = "idx AS (SELECT c_nationkey AS unit, avg(c_acctbal) AS idx FROM customer GROUP BY 1)"
AREA = "area AS (SELECT s_nationkey AS unit, count(*) AS area FROM supplier GROUP BY 1)"
FLAGS = "flags AS (SELECT DISTINCT c_nationkey AS unit, CAST(isoyear(CAST(o_orderdate AS DATE)) AS BIGINT) AS yr, 1 AS flag FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND isoyear(CAST(o_orderdate AS DATE)) >= 1998)"
POINTS = "points AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS DOUBLE) AS value FROM embeddings)"
PANEL = ", ".join([COUNTS, UNITS, CLIMATE, PEOPLE, INDEX, AREA, FLAGS]) + """, panel AS (
  SELECT c.*, u.name, u.grp, k.rain, k.temp, k.humid, i.idx, a.area, p.people, c.cases / CAST(p.people AS DOUBLE) * 100000 AS incidence,
    p.people / CAST(a.area AS DOUBLE) AS density, CAST(CASE WHEN c.yr < 1998 THEN 0 ELSE coalesce(f.flag, 0) END AS TINYINT) AS flag
  FROM counts c LEFT JOIN units u USING (unit) LEFT JOIN climate k ON k.yr = c.yr AND k.wk = c.wk AND k.unit = c.unit LEFT JOIN idx i ON i.unit = c.unit LEFT JOIN area a ON a.unit = c.unit
    LEFT JOIN people p ON p.unit = c.unit AND p.yr = c.yr LEFT JOIN flags f ON f.unit = c.unit AND f.yr = c.yr)"""
