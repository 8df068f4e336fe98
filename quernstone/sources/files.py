"""Sources and sinks: partitioned Parquet, archives of station files, JSON payloads, commented CSV, models."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions.scalars import decimal_comma, split_name

from .archives import archive_lines, failures, ledger, lines_of_archives  # noqa: F401

# Parts of vendor column names, in the order in which they are tried, and the names used here.
STATION_COLUMNS = [
    ("precipita", "precip_mm"),
    ("pressão atmosferica ao nivel", "pressao_hpa"),
    ("temperatura do ar", "temp_c"),
    ("temperatura máxima", "temp_max_c"),
    ("temperatura mínima", "temp_min_c"),
    ("umidade relativa do ar", "umidade_pct"),
    ("vento, velocidade", "vento_ms"),
    ("vento, dire", "vento_dir"),
    ("radia", "radiacao"),
]
# Metadata labels of a station file.
STATION_FIELDS = {"regiao": "REGI[AÃ]O", "uf": "UF", "estacao": "ESTA[CÇ][AÃ]O", "codigo_wmo": r"C[OÓ]DIGO \(WMO\)", "latitude": "LATITUDE", "longitude": "LONGITUDE", "altitude": "ALTITUDE", "data_fund": "DATA DE FUNDA[CÇ][AÃ]O"}


def project_wanted(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that exist, or all if none does, with names in lower case."""
    chosen = [c for c in df.columns if c.lower() in wanted] or df.columns
    return df.select(*[F.col(f"`{c}`").alias(c.strip().lower()) for c in chosen])


def scan_partitions(spark: SparkSession, root: str, columns: list[str], **keys: list) -> DataFrame:
    """Columns of a partitioned dataset; filters on partition columns prune folders."""
    df = spark.read.parquet(root)
    for k, values in keys.items():
        df = df.where(F.col(k).isin(*values))
    return df.select(*columns)


def sink_partitions(df: DataFrame, root: str, keys: list[str], rows_per_file: int = 300_000) -> None:
    """Replaces exactly the partitions that df has; running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").partitionBy(*keys).parquet(root)


def rename_by_pattern(df: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Each column takes the name of the first pattern that its own name holds, compared without accents; a name is given once."""
    bare = lambda text: "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    names: dict[str, str] = {}
    for c in df.columns:
        new = next((n for part, n in patterns if bare(part) in bare(c) and n not in names.values()), None)
        if new:
            names[c] = new
    return df.withColumnsRenamed(names)


def with_header(lines: DataFrame) -> DataFrame:
    """Adds ``header``, the number of a file's header line: among the first 20, begins with "data", five or more ";", no ":" before the first."""
    first = F.substring_index("line", ";", 1)
    is_header = (F.col("no") < 20) & F.lower("line").startswith("data") & ~F.contains(first, F.lit(":")) & (F.regexp_count("line", F.lit(";")) >= 5)
    w = Window.partitionBy("archive", "name")
    return lines.withColumn("header", F.min(F.when(is_header, F.col("no"))).over(w))


def station_metadata(lines: DataFrame) -> DataFrame:
    """One row per file: the fields of the lines above its header."""
    head = lines.where("error is null and no < coalesce(header, 20)")
    value = lambda label: F.max(F.when(F.upper("line").rlike(rf"^\s*{label}\s*:"), F.trim(F.regexp_extract("line", r"^[^;]*;?\s*([^;]*)", 1))))
    out = head.groupBy("archive", "name").agg(*[value(label).alias(k) for k, label in STATION_FIELDS.items()])
    return out.withColumns({k: decimal_comma(F.col(k)) for k in ("latitude", "longitude", "altitude")})


def timestamps(df: DataFrame, date: str, hour: str, file: str, name: str = "at") -> DataFrame:
    """Adds the time of a date and an hour as text ("00:00", "0000", "0000 UTC").

    Dates are read year first; in a file of which over half can't be read so, day first. The rate is an aggregate that every row of the file meets, not a window over it.
    """
    clock = F.lpad(F.substring(F.replace(hour, F.lit(":"), F.lit("")), 1, 4), 4, "0")
    read = lambda form: F.try_to_timestamp(F.concat_ws(" ", F.translate(date, "/", "-"), clock), F.lit(f"{form} HHmm"))
    both = df.withColumns({"_iso": read("yyyy-MM-dd"), "_dmy": read("dd-MM-yyyy")})
    bad = both.groupBy(F.col(file).alias("_file")).agg(F.avg(F.col("_iso").isNull().cast("double")).alias("_bad"))
    met = both.join(bad, F.col(file).eqNullSafe(F.col("_file")))
    return met.withColumn(name, F.when(F.col("_bad") > 0.5, F.col("_dmy")).otherwise(F.col("_iso")).cast("timestamp_ntz")).drop("_iso", "_dmy", "_bad", "_file")


def split_names(df: DataFrame, column: str, codes: tuple[str, ...] = (), name: str = "name", code: str = "code") -> DataFrame:
    """Rows whose text is "Name (XX)" with one of the codes (any two capitals if none are given), split; totals, footers and the rest are dropped."""
    parts = split_name(F.col(column), codes)
    return df.withColumns({name: parts[0], code: parts[1]}).where(F.col(code).isNotNull())


def missing_periods(expected: DataFrame, seen: DataFrame, key: str, failures: DataFrame | None = None) -> DataFrame:
    """The ledger of failures: expected periods without rows, and what could not be read."""
    out = expected.join(seen.select(key).distinct(), key, "left_anti").select(F.col(key).cast("string").alias("period"), F.lit("absent").alias("reason"))
    return out if failures is None else out.unionByName(failures)


def flatten_registry(raw: DataFrame, prefixes: dict[str, tuple[str, str, str]]) -> DataFrame:
    """(code, name, sigla, state, region): nested path A, else path B, else the code's prefix; a triple comes from one place."""
    a = F.struct(F.col("microrregiao.mesorregiao.UF.sigla").alias("sigla"), F.col("microrregiao.mesorregiao.UF.nome").alias("state"), F.col("microrregiao.mesorregiao.UF.regiao.nome").alias("region"))
    b = F.struct(F.col("regiao-imediata.regiao-intermediaria.UF.sigla").alias("sigla"), F.col("regiao-imediata.regiao-intermediaria.UF.nome").alias("state"), F.col("regiao-imediata.regiao-intermediaria.UF.regiao.nome").alias("region"))
    spark = raw.sparkSession
    table = spark.createDataFrame([(k, *v) for k, v in prefixes.items()], "prefix string, p_sigla string, p_state string, p_region string")
    rows = raw.select(F.col("id").cast("string").alias("code"), F.col("nome").alias("name"), F.when(a["sigla"].isNotNull(), a).when(b["sigla"].isNotNull(), b).alias("t")).withColumn("prefix", F.substring("code", 1, 2))
    out = rows.join(F.broadcast(table), "prefix", "left")  # 27 rows at most
    pick = lambda k: F.when(F.col("t").isNotNull(), F.col(f"t.{k}")).otherwise(F.col(f"p_{k}")).alias(k)
    return out.select("code", "name", pick("sigla"), pick("state"), pick("region")).where("sigla is not null")


def explode_series(payload: DataFrame, column: str, year: str) -> DataFrame:
    """(code, value) of a nested JSON payload of series; sentinels dropped."""
    from quernstone.functions.scalars import sentinel_int

    schema = "array<struct<resultados:array<struct<series:array<struct<localidade:struct<id:string>,serie:map<string,string>>>>>>>"
    series = F.explode(F.try_element_at(F.try_element_at(F.from_json(column, schema), F.lit(1))["resultados"], F.lit(1))["series"])
    rows = payload.select(series.alias("s")).select(F.col("s.localidade.id").alias("code"), sentinel_int(F.try_element_at(F.col("s.serie"), F.lit(year))).alias("value"))
    return rows.where("value is not null")


def commented_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)


def metric_json(df: DataFrame, path: str) -> None:
    """One JSON object a row, in one file: for metrics, whose rows are few."""
    df.coalesce(1).write.mode("overwrite").json(path)


def metric_csv(df: DataFrame, path: str) -> None:
    """A CSV table with header in one file: for result tables, whose rows are few."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
