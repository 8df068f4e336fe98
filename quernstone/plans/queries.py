"""Registered queries of the panel operators on the test tables, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import scalars as S
from quernstone.operators import graph, models, panel, series
from quernstone.sources import files

from .bindings import AREA, CATEGORIES, CLIMATE, COUNTS, FLAGS, INDEX, PANEL, PEOPLE, POINTS, PRINCIPAL, UNITS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, n=6):
    return F.round(c, n)


# --- sources and sinks


def _folder(t: Tables, name: str) -> str:
    import uuid

    return f"{graph.shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_totalprice, o_orderpriority, isoyear(CAST(o_orderdate AS DATE)) AS yr FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND isoyear(CAST(o_orderdate AS DATE)) IN (1996, 1997)")
def scan_partitioned(t):
    root = _folder(t, "parts")
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority", S.iso_year(F.col("o_orderdate").cast("date")).alias("yr"))
    files.sink_partitions(o, root, ["o_orderpriority", "yr"])
    return files.scan_partitions(t.spark, root, ["o_orderkey", "o_totalprice", "o_orderpriority", F.col("yr").cast("long").alias("yr")], o_orderpriority=["1-URGENT", "5-LOW"], yr=[1996, 1997])


@query("SELECT p_partkey, p_name, p_size FROM part")
def project_wanted(t):
    return files.project_wanted(t.part.withColumnRenamed("p_name", "P_NAME"), ["p_partkey", "p_name", "p_size", "absent"])


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def sink_partition_roundtrip(t):
    root = _folder(t, "sink")
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    files.sink_partitions(o, root, ["o_orderstatus"])
    files.sink_partitions(o.where("o_orderstatus = 'P'"), root, ["o_orderstatus"])  # again, one partition
    return t.spark.read.parquet(root).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_orderkey, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc FROM lineitem")
def rename_by_pattern(t):
    return files.rename_by_pattern(t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount"), [("quant", "qty"), ("price", "price"), ("disc", "disc")])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity % 7 <> 0 THEN round(l_extendedprice, 2) END AS price FROM lineitem")
def na_sentinels(t):
    raw = F.when(F.col("l_quantity") % 7 == 0, F.lit("-9999,0")).otherwise(F.replace(F.format_string("%.2f", "l_extendedprice"), F.lit("."), F.lit(",")))
    return t.lineitem.select("l_orderkey", "l_linenumber", S.decimal_comma(raw).alias("price"))


@query("SELECT CAST(y AS VARCHAR) AS period, 'absent' AS reason FROM range(1990, 2005) x(y) WHERE y NOT IN (SELECT isoyear(CAST(o_orderdate AS DATE)) FROM orders)")
def missing_periods(t):
    expected = t.spark.range(1990, 2005).select(F.col("id").alias("yr"))
    return files.missing_periods(expected, t.orders.select(S.iso_year(F.col("o_orderdate").cast("date")).alias("yr")), "yr")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT s_suppkey AS code, s_nationkey AS unit FROM supplier WHERE s_suppkey % 7 <> 0")
def csv_with_comments(t):
    """A table of the suppliers as CSV files in which some lines are comments."""
    at = _folder(t, "csv")
    code = F.concat(F.when(F.col("s_suppkey") % 7 == 0, "#").otherwise(""), F.col("s_suppkey").cast("string"))
    t.supplier.select(code.alias("code"), F.col("s_nationkey").alias("unit")).write.option("header", True).option("comment", "~").csv(at)
    return files.commented_csv(t.spark, at, "code long, unit int")


def _archives(t, periods=None):
    """A folder of ZIP archives of fifty suppliers each as station files, every second one in Latin-1; ``periods`` has the numbers of those
    to write, and may cut or damage one (see ``failure_ledger``)."""
    at = _folder(t, "archives")

    def pack(key, stations):
        import io
        import zipfile

        import pandas as pd
        from pyarrow import fs

        held, damage = io.BytesIO(), key[1]
        with zipfile.ZipFile(held, "w", zipfile.ZIP_STORED if damage else zipfile.ZIP_DEFLATED) as z:
            for k, unit, value in stations[["s_suppkey", "s_nationkey", "s_acctbal"]].itertuples(index=False):
                fields = ["REGIAO:;X", f"UF:;{unit:02d}", f"ESTAÇÃO:;n{k}", f"CODIGO (WMO):;S{k}", f"LATITUDE:;-{unit},5", "LONGITUDE:;10,25", "ALTITUDE:;7"]
                text = "\n".join([*fields, "Data;Hora UTC;PRECIPITAÇÃO TOTAL;b;c;d;", f"2024/01/01;0000 UTC;{value!r};;;;".replace(".", ","), "2024/01/01;0100 UTC;-9999;;;;"])
                z.writestr(f"S{k}.CSV", text.encode("latin-1" if k % 2 else "utf-8"))
            if damage == "member":
                z.writestr("BAD.CSV", b"to be damaged")
        body = held.getvalue()
        body = body[: len(body) // 2] if damage == "archive" else body.replace(b"to be damaged", b"was damaged..") if damage == "member" else body
        system, path = fs.FileSystem.from_uri(f"{at}/{2000 + key[0]}.zip") if "://" in at or at.startswith("file:") else (fs.LocalFileSystem(), f"{at}/{2000 + key[0]}.zip")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path) as f:
            f.write(body)
        return pd.DataFrame({"path": [path]})

    rows = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal", F.floor(F.col("s_suppkey") / 50).alias("a"))
    rows = rows.withColumn("damage", F.lit(None).cast("string")) if periods is None else rows.join(periods, "a")
    rows.groupBy("a", "damage").applyInPandas(pack, "path string").write.format("noop").mode("overwrite").save()
    return at


@query("SELECT 'S' || s_suppkey || '.CSV' AS name, s_acctbal AS value FROM supplier UNION ALL SELECT 'S' || s_suppkey || '.CSV', NULL FROM supplier")
def zip_csv_scan(t):
    """Readings of all files in the archives; the missing-value mark is null."""
    lines = files.with_header(files.archive_lines(t.spark, _archives(t)))
    return lines.where("no > header").select("name", S.decimal_comma(F.get(F.split("line", ";"), 2)).alias("value"))


@query("SELECT 'S' || s_suppkey || '.CSV' AS name, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS uf, 'n' || s_suppkey AS estacao, 'S' || s_suppkey AS codigo_wmo, -(s_nationkey + 0.5::DOUBLE) AS latitude, 10.25::DOUBLE AS longitude, 7.0::DOUBLE AS altitude FROM supplier")
def station_metadata(t):
    lines = files.with_header(files.archive_lines(t.spark, _archives(t)))
    return files.station_metadata(lines).select("name", "uf", "estacao", "codigo_wmo", "latitude", "longitude", "altitude")


@query("""WITH p AS (SELECT DISTINCT CAST(floor(s_suppkey / 50) AS BIGINT) AS a FROM supplier), x AS (SELECT CAST(2000 + a AS VARCHAR) AS period, 2000 + a || '.zip' AS archive, a % 4 AS k FROM p UNION ALL SELECT CAST(2000 + max(a) + 1 AS VARCHAR), NULL, 0 FROM p)
SELECT period, CASE WHEN k > 0 THEN archive END AS archive, CASE WHEN k = 2 THEN 'BAD.CSV' END AS name, CASE k WHEN 0 THEN 'absent' WHEN 1 THEN 'archive' ELSE 'member' END AS state, CASE k WHEN 0 THEN 'no archive' ELSE 'BadZipFile' END AS reason FROM x WHERE k < 3""")
def failure_ledger(t):
    """Of every four archives one is absent, one is cut off, one has a damaged member; the rest of that one is read."""
    a = t.supplier.select(F.floor(F.col("s_suppkey") / 50).alias("a")).distinct()
    damage = F.when(F.col("a") % 4 == 1, "archive").when(F.col("a") % 4 == 2, "member")
    lines = graph.stored(files.archive_lines(t.spark, _archives(t, a.where("a % 4 > 0").withColumn("damage", damage))))
    expected = a.unionByName(a.agg((F.max("a") + 1).alias("a"))).select(F.col("a") + 2000)
    return files.ledger(lines, expected).withColumn("reason", F.substring_index("reason", ":", 1))


@query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '00000' AS code, n_name AS name, CASE WHEN n_nationkey % 3 < 2 THEN 'S' || n_nationkey ELSE 'P' || n_nationkey END AS sigla, CASE WHEN n_nationkey % 3 < 2 THEN n_name ELSE 'state ' || n_nationkey END AS state, CASE WHEN n_nationkey % 3 < 2 THEN r_name ELSE 'known' END AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 < 2 OR n_nationkey < 15")
def flatten_registry(t):
    """Nations as nested registry objects: by the first path, the second, or neither, of which some have a known prefix."""
    uf = lambda: F.struct(F.concat(F.lit("S"), F.col("n_nationkey")).alias("sigla"), F.col("n_name").alias("nome"), F.struct(F.col("r_name").alias("nome")).alias("regiao"))
    part = F.col("n_nationkey") % 3
    first = F.when(part == 0, F.struct(F.struct(uf().alias("UF")).alias("mesorregiao")))
    second = F.when(part == 1, F.struct(F.struct(uf().alias("UF")).alias("regiao-intermediaria")))
    code = F.concat(S.pad_code(F.col("n_nationkey"), 2), F.lit("00000"))
    raw = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(code.alias("id"), F.col("n_name").alias("nome"), first.alias("microrregiao"), second.alias("regiao-imediata"))
    return files.flatten_registry(raw, {f"{i:02d}": (f"P{i}", f"state {i}", "known") for i in range(15)})


@query("SELECT CAST(c_nationkey AS VARCHAR) AS code, CAST(count(*) AS BIGINT) * 1000 AS value FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY c_nationkey")
def explode_series_json(t):
    """Counts by nation as a payload of nested JSON for each last digit, with thousands marks and sentinels."""
    n = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    text = F.when(F.col("c_nationkey") % 5 == 0, "...").otherwise(F.concat(F.col("n").cast("string"), F.lit(".000")))
    one = F.struct(F.struct(F.col("c_nationkey").cast("string").alias("id")).alias("localidade"), F.create_map(F.lit("2020"), text, F.lit("2019"), F.lit("-")).alias("serie"))
    # a nation has one series, so a payload has a tenth of the nations
    series_ = n.groupBy((F.col("c_nationkey") % 10).alias("k")).agg(F.collect_list(one).alias("series"))
    payload = series_.select(F.to_json(F.array(F.struct(F.array(F.struct("series")).alias("resultados")))).alias("payload"))
    return files.explode_series(payload, "payload", "2020")


# --- scalars


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders""")
def parse_dates(t):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("date")
    text = F.when(k == 0, F.date_format(d, "yyyyMMdd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).otherwise(F.lit("99/99/0000"))
    return t.orders.select("o_orderkey", S.parse_date(text).alias("d"))


@query("SELECT o_orderkey, CAST(week(CAST(o_orderdate AS DATE)) AS BIGINT) AS wk, CAST(isoyear(CAST(o_orderdate AS DATE)) AS BIGINT) AS yr FROM orders")
def iso_week(t):
    return panel.with_iso_week(t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")), "d").drop("d")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'")
def filter_period(t):
    return t.orders.where(F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1998-12-31").cast("timestamp_ntz"))).select("o_orderkey")


@query("SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 3 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END AS code FROM customer")
def pad_codes(t):
    return t.customer.select("c_custkey", S.pad_code(F.col("c_custkey"), 3).alias("code"))


_DIGIT = " + ".join(f"(CASE WHEN CAST(substr(code, {i + 1}, 1) AS INT) * {1 + i % 2} >= 10 THEN CAST(substr(code, {i + 1}, 1) AS INT) * {1 + i % 2} - 9 ELSE CAST(substr(code, {i + 1}, 1) AS INT) * {1 + i % 2} END)" for i in range(6))


@query(f"SELECT code, CAST((10 - ({_DIGIT}) % 10) % 10 AS BIGINT) AS dv FROM (SELECT lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS code FROM orders)")
def check_digit(t):
    code = S.pad_code(F.col("o_orderkey") % 1000000, 6)
    return t.orders.select(code.alias("code")).select("code", S.check_digit(F.col("code")).cast("long").alias("dv"))


@query("SELECT n_nationkey, coalesce(r_name, CASE substr(lpad(CAST(n_nationkey AS VARCHAR), 2, '0'), 1, 1) WHEN '0' THEN 'NORTH' WHEN '1' THEN 'SOUTH' END) AS grp FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 1")
def prefix_lookup(t):
    n = t.nation.join(t.region.where("r_regionkey <> 1"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return n.select("n_nationkey", F.coalesce("r_name", S.lookup(F.substring(S.pad_code(F.col("n_nationkey"), 2), 1, 1), {"0": "NORTH", "1": "SOUTH"})).alias("grp"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(strip_accents(text)), '[''`]', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) AS name FROM conversations")
def normalize_name_soft(t):
    return t.conversations.select("conv_id", "turn", S.plain_name(F.col("text")).alias("name"))


@query("SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]', '', 'g') AS name FROM documents")
def normalize_name_hard(t):
    return t.documents.select("doc_id", S.name_key(F.col("text")).alias("name"))


@query("SELECT c_custkey, c_name AS name, chr(65 + c_nationkey) || 'B' AS code FROM customer WHERE c_custkey % 5 <> 0 AND c_nationkey < 20")
def split_name_code(t):
    """Totals, and codes that aren't on the list, are dropped."""
    raw = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("Total "), "c_name")).otherwise(F.concat("c_name", F.lit(" ("), F.char(65 + F.col("c_nationkey")), F.lit("B)")))
    return files.split_names(t.customer.select("c_custkey", raw.alias("raw")), "raw", tuple(f"{chr(65 + i)}B" for i in range(20))).drop("raw")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 7 = 1 OR o_orderkey % 7 = 2 THEN NULL ELSE o_orderkey END AS n FROM orders")
def parse_sentinel_int(t):
    k = F.col("o_orderkey")
    grouped = F.format_number(k, 0)  # 1,234,567
    text = F.when(k % 7 == 0, F.lit("...")).when(k % 7 == 1, F.lit(" - ")).when(k % 7 == 2, F.lit("n/a")).when(k % 7 == 3, F.translate(grouped, ",", ".")).otherwise(F.concat(F.lit(" "), grouped))
    return t.orders.select("o_orderkey", S.sentinel_int(text).alias("n"))


@query("SELECT l_orderkey, l_linenumber, round((coalesce(CASE WHEN l_linenumber % 3 > 0 THEN l_quantity END, 0) * 0.3 + l_discount * 100 * 0.3) / (0.6 * 100), 4) AS score, round(1 - l_tax * 100 / 100, 6) AS rest FROM lineitem")
def weighted_score(t):
    d = t.lineitem.withColumns({"water": F.when(F.col("l_linenumber") % 3 > 0, F.col("l_quantity")), "waste": F.col("l_discount") * 100})
    return d.select("l_orderkey", "l_linenumber", S.weighted_score({"water": 0.3, "bath": 0.4, "waste": 0.3}, d.columns).alias("score"), r(S.complement((F.col("l_tax") * 100).cast("string"))).alias("rest"))


@query(f"WITH {COUNTS}, {PEOPLE} SELECT c.unit, c.yr, round(CASE WHEN people % 3 = 0 THEN NULL ELSE sum(cases) / CAST(people AS DOUBLE) * 100000 END, 6) AS incidence FROM counts c JOIN people p ON c.unit = p.unit AND c.yr = p.yr GROUP BY c.unit, c.yr, people")
def incidence_rate(t):
    c = t.counts().groupBy("unit", "yr").agg(F.sum("cases").alias("cases"))
    p = t.people().withColumn("people", F.when(F.col("people") % 3 == 0, 0).otherwise(F.col("people")))
    return panel.beside(c, p, ["unit", "yr"], "inner").select("unit", "yr", r(S.rate(F.col("cases"), F.col("people"))).alias("incidence"))


@query("WITH w AS (SELECT DISTINCT CAST(isoyear(CAST(o_orderdate AS DATE)) AS BIGINT) AS yr, CAST(week(CAST(o_orderdate AS DATE)) AS BIGINT) AS wk FROM orders), x AS (SELECT * FROM w UNION SELECT yr, 53 FROM w), m AS (SELECT yr, wk, date_trunc('week', make_date(yr, 1, 4)) + CAST((wk - 1) * 7 AS INTEGER) * INTERVAL 1 DAY AS d FROM x) SELECT yr, wk, CASE WHEN week(d) = wk THEN CAST(d AS DATE) END AS monday FROM m")
def isoweek_to_date(t):
    w = panel.with_iso_week(t.orders.select(F.col("o_orderdate").cast("date").alias("d")), "d").select("yr", "wk")
    return w.unionByName(w.withColumn("wk", F.lit(53).cast("long"))).distinct().withColumn("monday", S.week_start(F.col("yr"), F.col("wk")))


@query(f"WITH {COUNTS} SELECT wk, round(sin(wk * 2 * pi() / 52), 6) + 0 AS week_sin, round(cos(wk * 2 * pi() / 52), 6) + 0 AS week_cos FROM counts GROUP BY wk")
def cyclic_week(t):
    sin, cos = S.cyclic(F.col("wk"))
    return t.counts().select("wk").distinct().select("wk", r(sin).alias("week_sin"), r(cos).alias("week_cos"))


@query("SELECT event_id, user_id, date_trunc('hour', ts) AS at FROM events")
def build_timestamp(t):
    """Stations (files) with an odd number write day first; the format is chosen per file by what over half of it fits."""
    odd = F.col("user_id") % 2 == 1
    date = F.when(odd, F.date_format("ts", "dd/MM/yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    hour = F.date_format("ts", "HH")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(hour, F.lit(":00"))).when(F.col("event_id") % 3 == 1, F.concat(hour, F.lit("00 UTC"))).otherwise(F.concat(hour, F.lit("00")))
    raw = t.events.select("event_id", "user_id", date.alias("date"), text.alias("hour"))
    return files.timestamps(raw, "date", "hour", "user_id").select("event_id", "user_id", "at")


@query("SELECT o_orderkey, CASE WHEN isoyear(CAST(o_orderdate AS DATE)) <= 1997 THEN 'estimate' WHEN isoyear(CAST(o_orderdate AS DATE)) = 1998 THEN 'census' ELSE 'projection' END AS source FROM orders")
def case_by_year(t):
    y = S.iso_year(F.col("o_orderdate").cast("date"))
    return t.orders.select("o_orderkey", S.by_year(y, {1997: "estimate", 1998: "census"}, "projection").alias("source"))


@query("SELECT DISTINCT l_orderkey AS unit, CAST(CASE WHEN coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END, 0) + CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END > 0 THEN 1 ELSE 0 END AS BIGINT) AS flag FROM lineitem")
def row_sum_flag(t):
    d = t.lineitem.select(F.col("l_orderkey").alias("unit"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("string")).otherwise("-").alias("jan"), F.when(F.col("l_discount") > 0.05, "1").otherwise("x").alias("fev"))
    return d.select("unit", (S.month_sum(["jan", "fev"]) > 0).cast("long").alias("flag")).distinct()


_RING = ", ".join(f"({i}, {2 * i + 1}, {2 * i + 2})" for i in range(4))


@query(f"""WITH v AS (SELECT vec_id AS id, s AS seq, CAST(embedding[a] AS DOUBLE) AS x, CAST(embedding[b] AS DOUBLE) AS y FROM embeddings, (VALUES {_RING}) i(s, a, b)),
n AS (SELECT *, coalesce(lead(x) OVER w, first(x) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nx, coalesce(lead(y) OVER w, first(y) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ny FROM v WINDOW w AS (PARTITION BY id ORDER BY seq))
SELECT id, round(abs(sum(x * ny - nx * y)) / 2, 6) AS area FROM n GROUP BY id""")
def polygon_area(t):
    e = F.col("embedding")
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.lit(0).alias("ring"), F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), e[2 * i].cast("double").alias("x"), e[2 * i + 1].cast("double").alias("y")) for i in range(4)])).alias("p"))
    return panel.polygons(v.select("id", "ring", "p.*")).select("id", r(F.col("area")).alias("area"))


# --- joins


#: For each vector a square, a hole in it, an island in the hole and a square beside it; every second ring is turned round.
_RINGS = [(0, 0, 9), (1, 1, 6), (2, 2, 3), (20, 0, 2)]


@query("""WITH e AS (SELECT vec_id AS id, 1 + abs(CAST(embedding[1] AS DOUBLE)) AS s, CAST(embedding[2] AS DOUBLE) * 10 AS dx, CAST(embedding[3] AS DOUBLE) * 10 AS dy FROM embeddings),
g AS (SELECT id, s, dx, dy, a, b, w, CASE WHEN a = 1 THEN -1 ELSE 1 END AS sign FROM e, (VALUES (0, 0, 9), (1, 1, 6), (2, 2, 3), (20, 0, 2)) r(a, b, w)), x AS (SELECT id, sum(sign * w * w * s * s) AS area, sum(sign * w * w * s * s * (dx + (a + w / 2.0::DOUBLE) * s)) AS mx, sum(sign * w * w * s * s * (dy + (b + w / 2.0::DOUBLE) * s)) AS my FROM g GROUP BY id)
SELECT id, round(area, 6) AS area, round(mx / area, 6) AS cx, round(my / area, 6) AS cy FROM x""")
def polygon_holes(t):
    """Area and centroid of polygons of four rings, one of which is a hole, one an island in it."""
    e, s = F.col("embedding"), 1 + F.abs(F.col("embedding")[0].cast("double"))
    corners = [(k, i, a + w * dx, b + w * dy) for k, (a, b, w) in enumerate(_RINGS) for i, (dx, dy) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)][:: 1 - 2 * (k % 2)])]
    at = lambda x, j: (e[j].cast("double") * 10 + x * s)
    p = F.explode(F.array(*[F.struct(F.lit(k).alias("ring"), F.lit(i).alias("seq"), at(x, 1).alias("x"), at(y, 2).alias("y")) for k, i, x, y in corners]))
    out = panel.polygons(t.embeddings.select(F.col("vec_id").alias("id"), p.alias("p")).select("id", "p.*"))
    return out.select("id", *[r(F.col(c)).alias(c) for c in ("area", "cx", "cy")])


@query(f"WITH {COUNTS}, {UNITS} SELECT yr, wk, c.unit, cat, cases, name, grp FROM counts c LEFT JOIN units USING (unit)")
def join_dimension(t):
    return panel.beside(t.counts(), t.units(), "unit")


@query(f"WITH {COUNTS}, {CLIMATE} SELECT c.yr, c.wk, c.unit, cat, cases, round(rain, 6) AS rain, round(temp, 6) AS temp, round(humid, 6) AS humid FROM counts c LEFT JOIN climate k ON k.yr = c.yr AND k.wk = c.wk AND k.unit = c.unit")
def join_climate_week(t):
    out = t.counts().join(t.climate(), ["yr", "wk", "unit"], "left")
    return out.withColumns({c: r(F.col(c)) for c in ("rain", "temp", "humid")})


@query(f"WITH {UNITS}, {INDEX}, {AREA}, p AS (SELECT c_nationkey AS unit, count(*) AS people FROM customer GROUP BY 1) SELECT unit, round(idx, 6) AS idx, area, round(people / CAST(area AS DOUBLE), 6) AS density FROM units LEFT JOIN idx USING (unit) LEFT JOIN area USING (unit) LEFT JOIN p USING (unit)")
def join_static_chain(t):
    p = t.customer.groupBy(F.col("c_nationkey").alias("unit")).agg(F.count(F.lit(1)).alias("people"))
    out = panel.beside(panel.beside(panel.beside(t.units().select("unit"), t.index(), "unit"), t.area(), "unit"), p, "unit")
    return out.select("unit", r(F.col("idx")).alias("idx"), "area", r(F.try_divide(F.col("people").cast("double"), F.col("area").cast("double"))).alias("density"))


@query(f"WITH {COUNTS}, {FLAGS}, {PEOPLE} SELECT c.unit, c.yr, sum(cases) AS cases, max(people) AS people, CAST(max(coalesce(flag, 0)) AS BIGINT) AS flag FROM counts c LEFT JOIN flags f ON f.unit = c.unit AND f.yr = c.yr LEFT JOIN people p ON p.unit = c.unit AND p.yr = c.yr GROUP BY c.unit, c.yr")
def join_year_flag(t):
    out = panel.beside(panel.beside(t.counts().groupBy("unit", "yr").agg(F.sum("cases").cast("long").alias("cases")), t.flags(), ["unit", "yr"]), t.people(), ["unit", "yr"])
    return out.select("unit", "yr", "cases", "people", F.coalesce("flag", F.lit(0)).cast("long").alias("flag"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer))")
def semi_valid_codes(t):
    least = t.customer.agg(F.min("c_mktsegment").alias("m"))
    valid = t.customer.join(F.broadcast(least), F.col("c_mktsegment") == F.col("m"), "left_semi").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(valid, "o_custkey", "left_semi").select("o_orderkey")


def _names(t):
    """Customers' names, some written otherwise, some unknown, against the dimension of customers."""
    k = F.col("c_custkey")
    odd = F.when(k % 9 == 0, F.concat(F.lit("Ünknown "), "c_name")).when(k % 3 == 0, F.upper(F.replace("c_name", F.lit("#"), F.lit(" - ")))).otherwise(F.col("c_name"))
    left = t.customer.select("c_custkey", odd.alias("name"), F.col("c_nationkey").cast("string").alias("uf"))
    dim = t.customer.select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("uf"))
    return panel.name_match(left, dim, "name", "uf")


@query("SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey END AS code FROM customer")
def name_match_join(t):
    return _names(t).select("c_custkey", "code")


@query("SELECT count(*) AS n, count(CASE WHEN c_custkey % 9 <> 0 THEN 1 END) AS matched, round(100.0 * count(CASE WHEN c_custkey % 9 <> 0 THEN 1 END) / count(*), 2) AS pct FROM customer")
def name_match_rate(t):
    return _names(t).agg(F.count(F.lit(1)).alias("n"), F.count("code").alias("matched")).withColumn("pct", F.round(100.0 * F.col("matched") / F.col("n"), 2))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 9 = 0 ORDER BY c_custkey LIMIT 10")
def name_unmatched(t):
    return _names(t).where("code is null").orderBy("c_custkey").select("c_custkey").limit(10)


@query(f"WITH {POINTS}, s AS (SELECT * FROM points WHERE id % 10 = 0) SELECT u.id AS unit, arg_min(s.id, struct_pack(d := (u.x - s.x) * (u.x - s.x) + (u.y - s.y) * (u.y - s.y), i := s.id)) AS station FROM points u, s GROUP BY u.id")
def nearest_neighbor_join(t):
    p = graph.checkpoint(t.points())
    return panel.nearest_station(p, p.where("id % 10 = 0")).select("unit", "station")


_EDGES = POINTS + ", d AS (SELECT a.id AS src, b.id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM points a, points b WHERE a.id <> b.id), k AS (SELECT src, dst FROM d QUALIFY row_number() OVER (PARTITION BY src ORDER BY d2, dst) <= 5), e AS (SELECT src, dst FROM k UNION SELECT dst, src FROM k), w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e)"


@query(f"WITH {_EDGES} SELECT src, dst, round(w, 6) AS w FROM w")
def knn_edges(t):
    return graph.weights(graph.checkpoint(t.points())).withColumn("w", r(F.col("w")))


@query(f"WITH {POINTS} SELECT a.id AS src, b.id AS dst FROM points a, points b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.03::DOUBLE * 0.03::DOUBLE")
def range_self_join(t):
    return graph.within(t.points(), 0.03).select("src", "dst")


_ROUND = ["rain", "temp", "humid", "idx", "incidence", "density"]


@query(f"WITH {PANEL} SELECT yr, wk, unit, cat, cases, name, grp, area, people, CAST(flag AS BIGINT) AS flag, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUND)} FROM panel")
def integrated_panel(t):
    return t.panel().withColumns({c: r(F.col(c)) for c in _ROUND} | {"flag": F.col("flag").cast("long")})


# --- aggregations


@query(f"WITH {COUNTS} SELECT * FROM counts")
def cases_by_week(t):
    return t.counts()


_DAILY = "days AS (SELECT user_id, CAST(ts AS DATE) AS day, coalesce(sum(value), 0) AS total, avg(value) AS mean, max(value) AS high, min(value) AS low FROM events WHERE ts IS NOT NULL GROUP BY ALL)"


@query(f"WITH {_DAILY} SELECT user_id, day, round(total, 6) AS total, round(mean, 6) AS mean, high, low FROM days")
def hourly_to_daily(t):
    return panel.daily(t.events, "user_id", "ts", "value").withColumns({c: r(F.col(c)) for c in ("total", "mean")})


@query(f"WITH {_DAILY} SELECT user_id, CAST(isoyear(day) AS BIGINT) AS yr, CAST(week(day) AS BIGINT) AS wk, round(sum(total), 6) AS total, round(avg(mean), 6) AS mean, round(avg(high), 6) AS high, round(avg(low), 6) AS low FROM days GROUP BY ALL")
def daily_to_weekly(t):
    return panel.weekly(panel.daily(t.events, "user_id", "ts", "value"), "user_id").withColumns({c: r(F.col(c)) for c in ("total", "mean", "high", "low")})


@query(f"WITH {_DAILY.replace('SELECT user_id', 'SELECT user_id, event_type')} SELECT user_id, event_type, CAST(isoyear(day) AS BIGINT) AS yr, CAST(week(day) AS BIGINT) AS wk, round(sum(total), 6) AS total, round(avg(mean), 6) AS mean, round(avg(high), 6) AS high, round(avg(low), 6) AS low FROM days GROUP BY ALL")
def weekly_by_keys(t):
    """Weeks of places that two columns name."""
    keys = ["user_id", "event_type"]
    return panel.weekly(panel.daily(t.events, keys, "ts", "value"), keys).withColumns({c: r(F.col(c)) for c in ("total", "mean", "high", "low")})


@query(f"WITH {COUNTS}, {UNITS} SELECT grp, {', '.join(f'''CAST(coalesce(sum(CASE WHEN cat = '{c}' THEN cases END), 0) AS BIGINT) AS "{c}"''' for c in CATEGORIES)} FROM counts JOIN units USING (unit) WHERE grp IS NOT NULL GROUP BY grp")
def pivot_region_category(t):
    return panel.pivot_sum(panel.beside(t.counts(), t.units(), "unit"), "grp", "cat", CATEGORIES, "cases")


@query(f"WITH {COUNTS} SELECT yr, wk, CAST(sum(cases) AS BIGINT) AS cases FROM counts WHERE cat = '{PRINCIPAL}' GROUP BY ALL")
def weekly_curve(t):
    return t.counts().where(F.col("cat") == PRINCIPAL).groupBy("yr", "wk").agg(F.sum("cases").alias("cases"))


_SERIES = COUNTS + ", s AS (SELECT cat, CAST(date_trunc('week', make_date(yr, 1, 4)) + CAST((wk - 1) * 7 AS INTEGER) * INTERVAL 1 DAY AS DATE) AS monday, CAST(sum(cases) AS BIGINT) AS cases FROM counts WHERE wk BETWEEN 1 AND 52 GROUP BY ALL)"


def _series(t, last=52):
    return t.counts().where(F.col("wk").between(1, last)).groupBy("yr", "wk", "cat").agg(F.sum("cases").alias("cases")).select("cat", S.week_start(F.col("yr"), F.col("wk")).alias("monday"), "cases")


@query(f"WITH {_SERIES.replace('BETWEEN 1 AND 52', 'BETWEEN 1 AND 53')} SELECT * FROM s")
def weekly_series(t):
    return _series(t, 53)


@query(f"WITH {COUNTS}, x AS (SELECT cat, CAST(sum(cases) AS BIGINT) AS total FROM counts GROUP BY cat) SELECT cat, total, round(100.0::DOUBLE * total / sum(total) OVER (), 1) AS pct FROM x")
def category_share(t):
    return panel.share_of_total(t.counts(), "cat", "cases").withColumn("pct", F.col("pct").cast("double"))


_REGIONAL = PANEL + f", reg AS (SELECT grp, yr, wk, CAST(sum(cases) AS BIGINT) AS cases, avg(rain) AS rain, avg(temp) AS temp, avg(humid) AS humid, avg(idx) AS idx FROM panel WHERE grp IS NOT NULL AND cat = '{PRINCIPAL}' GROUP BY ALL)"
_VARIABLES = ["rain", "temp", "humid"]


def _regional(t):
    return panel.regional(t.panel().where(F.col("cat") == PRINCIPAL), [*_VARIABLES, "idx"])


@query(f"WITH {_REGIONAL} SELECT grp, yr, wk, cases, round(rain, 6) AS rain, round(temp, 6) AS temp, round(humid, 6) AS humid, round(idx, 6) AS idx FROM reg")
def regional_panel(t):
    return _regional(t).withColumns({c: r(F.col(c)) for c in (*_VARIABLES, "idx")})


_INCIDENCE = PANEL + ", inc AS (SELECT unit, CAST(sum(cases) AS BIGINT) AS cases, max(people) AS people, max(idx) AS idx, min(grp) AS grp, min(name) AS name, sum(cases) / CAST(max(people) AS DOUBLE) * 100000 AS incidence FROM panel GROUP BY unit)"


def _incidence(t):
    sums = t.panel().groupBy("unit").agg(F.sum("cases").alias("cases"), F.max("people").alias("people"), F.max("idx").alias("idx"), F.min("grp").alias("grp"), F.min("name").alias("name"))
    return sums.withColumn("incidence", S.rate(F.col("cases"), F.col("people")))


@query(f"WITH {_INCIDENCE} SELECT unit, cases, people, round(idx, 6) AS idx, grp, name, round(incidence, 6) AS incidence FROM inc")
def unit_incidence(t):
    return _incidence(t).withColumns({c: r(F.col(c)) for c in ("idx", "incidence")})


@query(f"WITH {_INCIDENCE} SELECT grp, round(avg(incidence), 6) AS incidence FROM inc GROUP BY grp ORDER BY 2")
def group_mean_rate(t):
    return _incidence(t).groupBy("grp").agg(r(F.avg("incidence")).alias("incidence")).orderBy("incidence")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.75) FROM orders)")
def p75_filter(t):
    return panel.upper_quartile(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, rank() OVER w + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS mean_rank, round(cume_dist() OVER w, 9) AS share FROM lineitem WINDOW w AS (ORDER BY l_quantity)")
def value_ranks(t):
    """Ranks over a column of few values, each of which many rows share."""
    return panel.ranks(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_quantity").withColumn("share", r(F.col("share"), 9))


@query(f"WITH {POINTS}, km AS (SELECT id, x * 111.0::DOUBLE * cos(radians(y)) AS x, y * 111.0::DOUBLE AS y FROM points), d AS (SELECT a.id AS src, b.id AS dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM km a, km b WHERE a.id <> b.id) SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS INTEGER) AS rank, round(d2, 6) AS d2 FROM d QUALIFY row_number() OVER (PARTITION BY src ORDER BY d2, dst) <= 3")
def knn_km(t):
    """The three nearest points in kilometres on the plane."""
    p = graph.checkpoint(t.points())
    return graph.nearest(p, p, 3, itself=False, metric="km").select("src", "dst", "rank", r(F.col("d2")).alias("d2"))


_PAIRS = ", ".join(f"('{v}', {n})" for v in _VARIABLES for n in range(1, 5))
_LAGS = _REGIONAL + ", l AS (" + " UNION ALL ".join(f"SELECT grp, '{v}' AS variable, {n} AS lag, lag({v}, {n}) OVER (PARTITION BY grp ORDER BY yr, wk) AS x, CAST(cases AS DOUBLE) AS y FROM reg" for v in _VARIABLES for n in range(1, 5)) + ") , m AS (SELECT grp, variable, CAST(lag AS BIGINT) AS lag, count(x) AS n, CASE WHEN count(x) >= 30 AND var_pop(x) * var_pop(y) > 0 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END AS r FROM l WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL)"


def _correlations(t, lags=(1, 2, 3, 4)):
    out = panel.lag_correlations(_regional(t), _VARIABLES, "cases", list(lags), "grp", ["yr", "wk"])
    return out.withColumn("lag", F.col("lag").cast("long"))


@query(f"WITH {_LAGS} SELECT grp, variable, lag, n, round(r, 5) AS r FROM m")
def lag_correlation(t):
    return _correlations(t).withColumn("r", r(F.col("r"), 5))


def _p_sql(r: str, n: str) -> str:
    """Two-sided p of a correlation by the finite sums of Student's distribution for whole degrees of freedom."""
    even = f"abs({r}) * list_sum(list_transform(range(0, ({n} - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi()) + k * ln(1 - {r} * {r}))))"
    odd = f"2 / pi() * (asin(abs({r})) + abs({r}) * coalesce(list_sum(list_transform(range(0, ({n} - 3) // 2), lambda k: sqrt(1 - {r} * {r}) * exp(lgamma(k + 1) + ln(sqrt(pi()) / 2) - lgamma(k + 1.5) + k * ln(1 - {r} * {r})))), 0))"
    return f"CASE WHEN {r} IS NULL OR {n} < 3 THEN NULL WHEN {r} = 0 OR abs({r}) >= 1 THEN ({r} = 0)::INT::DOUBLE ELSE round(1 - CASE WHEN {n} % 2 = 0 THEN {even} ELSE {odd} END, 4) + 0.0 END"


@query(f"WITH {_LAGS} SELECT grp, variable, lag, n, round(r, 5) AS r, {_p_sql('r', 'n')} AS p FROM m")
def lag_correlation_p(t):
    return _correlations(t).withColumn("p", _p(F.col("r"), F.col("n"))).withColumn("r", r(F.col("r"), 5))


def _p(of, n):
    return F.abs(r(panel.p_value(of, n), 4))


_BEST = _LAGS + ", b AS (SELECT grp, variable, CASE WHEN r IS NULL THEN 0 ELSE lag END AS lag, coalesce(r, 0) AS r, n FROM m QUALIFY row_number() OVER (PARTITION BY grp, variable ORDER BY abs(r) DESC NULLS LAST, lag) = 1)"


@query(f"WITH {_BEST} SELECT grp, variable, CAST(lag AS BIGINT) AS lag, round(r, 5) AS r, {_p_sql('r', 'n')} AS p FROM b")
def best_lag(t):
    return panel.best_lags(_correlations(t), "grp").select("grp", "variable", "lag", r(F.col("r"), 5).alias("r"), _p(F.col("r"), F.col("n")).alias("p"))


@query(f"WITH {_BEST}, z AS (SELECT grp, 'idx' AS variable, 0 AS lag, CASE WHEN count(idx) >= 30 AND var_pop(idx) * var_pop(cases) > 0 THEN covar_pop(idx, cases) / sqrt(var_pop(idx) * var_pop(cases)) END AS r, count(idx) AS n FROM reg WHERE idx IS NOT NULL GROUP BY grp) SELECT grp, variable, CAST(lag AS BIGINT) AS lag, round(r, 3) AS r, {_p_sql('r', 'n')} AS p FROM b UNION ALL SELECT grp, variable, lag, round(r, 3), {_p_sql('r', 'n')} FROM z")
def correlation_table(t):
    reg = graph.checkpoint(_regional(t))
    lagged = panel.best_lags(panel.lag_correlations(reg, _VARIABLES, "cases", [1, 2, 3, 4], "grp", ["yr", "wk"]), "grp").select("grp", "variable", "lag", "r", "n")
    flat = panel.lag_correlations(reg, ["idx"], "cases", [0], "grp", ["yr", "wk"]).select("grp", "variable", F.col("lag").cast("long").alias("lag"), "r", "n")
    return lagged.unionByName(flat).select("grp", "variable", "lag", r(F.col("r"), 3).alias("r"), _p(F.col("r"), F.col("n")).alias("p"))


@query(f"WITH {_BEST} SELECT variable, " + ", ".join(f"round(max(CASE WHEN grp = '{g}' THEN r END), 3) AS \"{g}\"" for g in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM b GROUP BY variable")
def correlation_matrix(t):
    best = panel.best_lags(_correlations(t), "grp").withColumn("r", r(F.col("r"), 3))
    return best.groupBy("variable").pivot("grp", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]).agg(F.max("r"))


@query("SELECT CAST(isoyear(CAST(o_orderdate AS DATE)) AS BIGINT) AS yr, count(*) AS n FROM orders GROUP BY 1")
def count_by_year(t):
    return t.orders.groupBy(S.iso_year(F.col("o_orderdate").cast("date")).alias("yr")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus AS part, count(*) AS rows_in, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS rows_out, round(100.0::DOUBLE * sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) / count(*), 2) AS pct FROM orders GROUP BY ROLLUP (o_orderstatus)")
def row_accounting(t):
    return panel.accounting(t.orders.withColumnRenamed("o_orderstatus", "part"), F.col("o_totalprice") > 100000, "part").withColumn("pct", F.col("pct").cast("double"))


@query("SELECT DISTINCT * FROM lineitem")
def dedup_rows(t):
    """Whole rows: copies are made by adding the table's small orders again."""
    return t.lineitem.unionByName(t.lineitem.where("l_quantity < 10")).dropDuplicates()


_KEYED = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


@query(f"SELECT {_KEYED} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1")
def dedup_key(t):
    return panel.first_by(t.lineitem.select(*_KEYED.split(", ")), ["l_orderkey", "l_linenumber"], *map(F.col, ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")))


# --- windows

_ORDERED = COUNTS + f", one AS (SELECT * FROM counts WHERE cat = '{PRINCIPAL}')"


@query(f"WITH {_ORDERED} SELECT unit, yr, wk, cases, {', '.join(f'lag(cases, {i}) OVER w AS cases_lag_{i}' for i in range(1, 9))} FROM one WINDOW w AS (PARTITION BY unit ORDER BY yr, wk)")
def lag_features(t):
    return models.lags(t.counts().where(F.col("cat") == PRINCIPAL).drop("cat"), {"cases": 8})


@query(f"WITH {PANEL} SELECT unit, yr, wk, {', '.join(f'round(lag({c}, {i}) OVER w, 6) AS {c}_lag_{i}' for c in _VARIABLES for i in range(1, 5))} FROM panel WHERE cat = '{PRINCIPAL}' WINDOW w AS (PARTITION BY unit ORDER BY yr, wk)")
def climate_lags(t):
    out = models.lags(t.panel().where(F.col("cat") == PRINCIPAL), dict.fromkeys(_VARIABLES, 4))
    return out.select("unit", "yr", "wk", *[r(F.col(f"{c}_lag_{i}")).alias(f"{c}_lag_{i}") for c in _VARIABLES for i in range(1, 5)])


@query(f"WITH {_ORDERED} SELECT unit, yr, wk, lead(cases, 4) OVER (PARTITION BY unit ORDER BY yr, wk) AS target FROM one")
def lead_target(t):
    return models.lags(t.counts().where(F.col("cat") == PRINCIPAL), {}, ("cases", 4)).select("unit", "yr", "wk", "target")


def _matrix(t):
    return models.feature_matrix(t.panel(), PRINCIPAL, _VARIABLES, ["idx", "density", "flag", "absent"])


_LONG = [f"cases_lag_{i}" for i in range(1, 9)]
_FLOAT = [f"{c}_lag_{i}" for c in _VARIABLES for i in range(1, 5)] + ["week_sin", "week_cos", "idx", "density"]


@query(f"""WITH {PANEL}, f AS (SELECT unit, yr, wk, idx, density, CAST(flag AS BIGINT) AS flag, sin(wk * 2 * pi() / 52) AS week_sin, cos(wk * 2 * pi() / 52) AS week_cos, lead(cases, 4) OVER w AS target,
{', '.join(f'lag(cases, {i}) OVER w AS cases_lag_{i}' for i in range(1, 9))}, {', '.join(f'lag({c}, {i}) OVER w AS {c}_lag_{i}' for c in _VARIABLES for i in range(1, 5))} FROM panel WHERE cat = '{PRINCIPAL}' WINDOW w AS (PARTITION BY unit ORDER BY yr, wk))
SELECT unit, yr, wk, target, flag, {', '.join(_LONG)}, {', '.join(f'round({c}, 6) AS {c}' for c in _FLOAT)} FROM f WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*_LONG, *_FLOAT, 'flag', 'target'])}""")
def feature_matrix(t):
    out, names = _matrix(t)
    return out.select("unit", "yr", "wk", "target", F.col("flag").cast("long").alias("flag"), *_LONG, *[r(F.col(c)).alias(c) for c in _FLOAT])


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(t):
    return panel.first_by(t.events, ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


_SPINE = _SERIES + ", span AS (SELECT cat, min(monday) AS a, max(monday) AS z FROM s GROUP BY cat), spine AS (SELECT cat, CAST(unnest(generate_series(a, z, INTERVAL 7 DAY)) AS DATE) AS monday FROM span), sp AS (SELECT cat, monday, CASE WHEN s.cases % 5 <> 0 THEN CAST(s.cases AS DOUBLE) END AS cases FROM spine LEFT JOIN s USING (cat, monday))"
_FILLED = _SPINE + """, g AS (SELECT *, row_number() OVER w AS i, last_value(CASE WHEN cases IS NOT NULL THEN monday END IGNORE NULLS) OVER b AS da, last_value(cases IGNORE NULLS) OVER b AS va, first_value(CASE WHEN cases IS NOT NULL THEN monday END IGNORE NULLS) OVER f AS dz, first_value(cases IGNORE NULLS) OVER f AS vz FROM sp
WINDOW w AS (PARTITION BY cat ORDER BY monday), b AS (PARTITION BY cat ORDER BY monday ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY cat ORDER BY monday ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
h AS (SELECT *, (monday - da) // 7 AS p FROM g), filled AS (SELECT cat, monday, CASE WHEN cases IS NOT NULL THEN cases WHEN p <= 3 AND dz IS NOT NULL THEN va + (vz - va) * CAST(monday - da AS DOUBLE) / (dz - da) WHEN p <= 3 THEN va ELSE 0 END AS cases FROM h)"""


def _holes(t):
    """The weekly series on its spine, with every count that five divides taken out, so that there are gaps to fill."""
    s = series.spine(_series(t), "cat", "monday")
    return s.withColumn("cases", F.when(F.col("cases") % 5 != 0, F.col("cases").cast("double")))


@query(f"WITH {_SPINE} SELECT * FROM sp")
def weekly_spine(t):
    return _holes(t)


@query(f"WITH {_FILLED} SELECT cat, monday, round(coalesce(cases, 0), 6) AS cases FROM filled")
def interpolate_limit(t):
    return series.fill_gaps(_holes(t), "cat", "monday", "cases").withColumn("cases", r(F.col("cases")))


@query(f"WITH {_FILLED.replace('CASE WHEN s.cases % 5 <> 0 THEN CAST(s.cases AS DOUBLE) END', 'CAST(s.cases AS DOUBLE)')} SELECT cat, monday, round(coalesce(cases, 0), 6) AS cases FROM filled")
def series_prepared(t):
    return _prepared(t).withColumn("cases", r(F.col("cases")))


def _prepared(t):
    return series.fill_gaps(series.spine(_series(t), "cat", "monday"), "cat", "monday", "cases")


@query("WITH o AS (SELECT isoyear(CAST(o_orderdate AS DATE)) AS yr FROM orders) SELECT CAST(yr AS BIGINT) AS yr, CASE WHEN (SELECT count(*) FROM o) > 1000 THEN least(count(*), 100) ELSE count(*) END AS n FROM o GROUP BY yr")
def stratified_cap(t):
    o = t.orders.withColumn("yr", S.iso_year(F.col("o_orderdate").cast("date")))
    return models.stratified_cap(o, "yr", ["o_orderkey"], over=1000, cap=100).groupBy("yr").agg(F.count(F.lit(1)).alias("n"))


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS ordinal, count(*) OVER () AS n FROM orders) SELECT o_orderkey, ordinal, CAST(greatest(0, floor((ordinal - (n - 5 * (n // 6))) / (n // 6)::DOUBLE) + 1) AS BIGINT) AS fold FROM o")
def expanding_folds(t):
    o = models.ordinal(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    return models.folds(o, t.orders.count()).select("o_orderkey", "ordinal", F.col("fold").cast("long").alias("fold"))


# --- top-k and sets


@query(f"WITH {_INCIDENCE} SELECT unit, name, round(incidence, 6) AS incidence FROM inc WHERE incidence IS NOT NULL ORDER BY inc.incidence DESC, unit LIMIT 10")
def top10_units(t):
    return _incidence(t).where("incidence is not null").orderBy(F.desc("incidence"), "unit").limit(10).select("unit", "name", r(F.col("incidence")).alias("incidence"))


@query("SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, NULL AS place FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def union_by_name(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return a.unionByName(t.supplier.select(F.col("s_nationkey").alias("place"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")), allowMissingColumns=True)


@query("SELECT DISTINCT c_nationkey AS unit FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 5000")
def except_labels(t):
    return t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("unit")).subtract(t.supplier.where("s_acctbal < 5000").select("s_nationkey"))


@query(f"WITH {POINTS} SELECT DISTINCT round(x, 1) + 0 AS x, round(y, 1) + 0 AS y FROM points")
def distinct_points(t):
    return t.points().select(r(F.col("x"), 1).alias("x"), r(F.col("y"), 1).alias("y")).distinct()


# --- series, space, models


def _components_of_series(t):
    return series.stl(_prepared(t), "cat", "monday", "cases")


@query()
def stl_components(t):
    return _components_of_series(t)


@query()
def seasonal_strength(t):
    return series.seasonal_strength(_components_of_series(t), "cat")


@query(f"WITH {COUNTS} SELECT yr, wk, cat, CAST(sum(cases) AS BIGINT) AS cases, CASE WHEN yr <= 1999 THEN 'train' ELSE 'test' END AS part FROM counts WHERE wk <= 52 AND yr <= 2000 GROUP BY yr, wk, cat")
def split_by_isoyear(t):
    c = t.counts().where("wk <= 52 and yr <= 2000").groupBy("yr", "wk", "cat").agg(F.sum("cases").alias("cases"))
    return c.withColumn("part", F.when(F.col("yr") <= 1999, "train").otherwise("test"))


@query()
def seasonal_forecast(t):
    """Trained up to 1999; forecast beside the actual week, joined on its date."""
    s = graph.checkpoint(_prepared(t))
    f = series.forecast(s.where("monday < '2000-01-01'"), "cat", "monday", "cases")
    return f.join(s, ["cat", "monday"], "left")


@query()
def forecast_coverage(t):
    """How much of the first 52 held-out weeks lies in the band, by category."""
    return series.coverage(seasonal_forecast(t), "cases", "lower", "upper", ["cat"])


@query("SELECT l_returnflag, round(sqrt(avg((l_quantity - l_extendedprice / 1000) * (l_quantity - l_extendedprice / 1000))), 5) AS rmse, round(avg(abs(l_quantity - l_extendedprice / 1000)), 5) AS mae, round(1 - sum((l_quantity - l_extendedprice / 1000) * (l_quantity - l_extendedprice / 1000)) / (var_pop(l_quantity) * count(*)), 5) AS r2 FROM lineitem GROUP BY 1")
def error_metrics(t):
    return series.errors(t.lineitem.withColumn("p", F.col("l_extendedprice") / 1000), "l_quantity", "p", ["l_returnflag"]).withColumns({c: r(F.col(c), 5) for c in ("rmse", "mae", "r2")})


@query(f"WITH {_EDGES}, z AS (SELECT id, coalesce(value, 0) - avg(coalesce(value, 0)) OVER () AS z, count(*) OVER () AS n FROM points) SELECT round((SELECT max(n) FROM z) * sum(w * a.z * b.z) / (sum(w) * (SELECT sum(z * z) FROM z)), 6) AS moran_i FROM w JOIN z a ON a.id = src JOIN z b ON b.id = dst")
def moran_i(t):
    p = graph.checkpoint(t.points())
    return graph.moran(p, graph.weights(p)).select(r(F.col("moran_i")).alias("moran_i"))


_NEAR = POINTS + ", near AS (SELECT a.id AS src, b.id AS dst FROM points a, points b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.03::DOUBLE * 0.03::DOUBLE), core AS (SELECT src AS id FROM near GROUP BY src HAVING count(*) >= 5)"


@query(f"WITH {_NEAR} SELECT id FROM core")
def dbscan_core_points(t):
    return graph.core_points(t.points(), 0.03)


@query(f"WITH RECURSIVE {_NEAR}, inner_edges AS (SELECT src, dst FROM near WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)), reach AS (SELECT id, id AS other FROM core UNION SELECT reach.id, e.dst FROM reach JOIN inner_edges e ON e.src = reach.other), lab AS (SELECT id, min(other) AS label FROM reach GROUP BY id), num AS (SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM lab), border AS (SELECT src AS id, min(cluster) AS cluster FROM near JOIN num ON dst = num.id GROUP BY src) SELECT p.id, num.id IS NOT NULL AS core, CAST(coalesce(num.cluster, border.cluster, -1) AS BIGINT) AS cluster FROM points p LEFT JOIN num ON num.id = p.id LEFT JOIN border ON border.id = p.id")
def dbscan_clusters(t):
    return graph.dbscan(graph.checkpoint(t.points()), 0.03)


#: The same points as degrees on the kilometre plane, those of high values only; the radius in kilometres.
_KM, _NEAR_KM = "SELECT id, x * 111.0::DOUBLE * cos(radians(y)) AS x, y * 111.0::DOUBLE AS y FROM points WHERE value >= (SELECT quantile_cont(value, 0.75) FROM points)", 4.0
_DENSE = POINTS + f", high AS ({_KM}), near AS (SELECT a.id AS src, b.id AS dst FROM high a, high b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {_NEAR_KM}::DOUBLE * {_NEAR_KM}::DOUBLE), core AS (SELECT src AS id FROM near GROUP BY src HAVING count(*) >= 5), inner_edges AS (SELECT src, dst FROM near WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)), reach AS (SELECT id, id AS other FROM core UNION SELECT reach.id, e.dst FROM reach JOIN inner_edges e ON e.src = reach.other), lab AS (SELECT id, min(other) AS label FROM reach GROUP BY id), num AS (SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM lab), border AS (SELECT src AS id, min(cluster) AS cluster FROM near JOIN num ON dst = num.id GROUP BY src), dense AS (SELECT p.id, num.id IS NOT NULL AS core, CAST(coalesce(num.cluster, border.cluster, -1) AS BIGINT) AS cluster FROM high p LEFT JOIN num ON num.id = p.id LEFT JOIN border ON border.id = p.id)"


def _high(p):
    x, y = S.plane_km(F.col("y"), F.col("x"))
    return graph.checkpoint(panel.upper_quartile(p, "value").select("id", x.alias("x"), y.alias("y")))


@query(f"WITH RECURSIVE {_DENSE} SELECT id, core, cluster FROM dense")
def high_rate_clusters(t):
    """Points of the upper quartile, on the kilometre plane, by density."""
    return graph.dbscan(_high(graph.checkpoint(t.points())), _NEAR_KM)


@query(f"WITH RECURSIVE {_DENSE}, {_EDGES.removeprefix(POINTS).lstrip(', ')}, z AS (SELECT id, coalesce(value, 0) - avg(coalesce(value, 0)) OVER () AS z, count(*) OVER () AS n FROM points) SELECT (SELECT count(*) FROM points) AS units, round((SELECT max(n) FROM z) * sum(w * a.z * b.z) / (sum(w) * (SELECT sum(z * z) FROM z)), 6) AS moran_i, (SELECT coalesce(max(cluster), -1) + 1 FROM dense) AS clusters, round((SELECT quantile_cont(value, 0.75) FROM points), 6) AS p75 FROM w JOIN z a ON a.id = src JOIN z b ON b.id = dst")
def spatial_summary(t):
    """Units, Moran I, clusters among the units of high rate, and the cut: four aggregates of one row."""
    p = graph.checkpoint(t.points())
    clusters = graph.dbscan(_high(p), _NEAR_KM).agg((F.coalesce(F.max("cluster"), F.lit(-1)) + 1).alias("clusters"))
    units, cut = p.agg(F.count(F.lit(1)).alias("units")), graph.quantile(p, "value", 0.75).select(r(F.col("cut")).alias("p75"))
    moran = graph.moran(p, graph.weights(p)).select(r(F.col("moran_i")).alias("moran_i"))
    one = [d.withColumn("_one", F.lit(1)) for d in (units, moran, clusters, cut)]
    return reduce(lambda a, b: a.join(b, "_one"), one).drop("_one")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def linreg_simple(t):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), r(F.regr_r2(y, x)).alias("r2"))


def _folded(t, order=("yr", "wk", "unit")):
    out, names = _matrix(t)
    out = graph.stored(out)
    out = graph.stored(models.folds(graph.ordinal(out, list(order)), out.count()))
    return models.assembled(out, names), names


@query()
def linreg_cv(t):
    return models.cross_validate(_folded(t)[0], "linear")


@query()
def rf_cv(t):
    return models.cross_validate(_folded(t)[0], "forest")


@query()
def gbt_cv(t):
    return models.cross_validate(_folded(t)[0], "boosted")


@query()
def cv_summary(t):
    df = _folded(t)[0]
    return reduce(DataFrame.unionByName, [models.summary(models.cross_validate(df, k), k) for k in ("linear", "forest", "boosted")])


@query()
def rf_importance(t):
    df, names = _folded(t)
    return models.importances(models.estimator("forest").fit(df), names, t.spark)


@query()
def predicted_vs_actual(t):
    df = _folded(t)[0]
    return models.estimator("forest").fit(df.where("fold < 5")).transform(df.where("fold = 5")).select("unit", "yr", "wk", "label", "prediction")


@query()
def learning_curve(t):
    return models.learning_curve(_folded(t)[0], "forest")


@query()
def learning_curve_boosted(t):
    return models.learning_curve(_folded(t)[0], "boosted")


@query()
def model_roundtrip(t):
    from pyspark.ml.regression import LinearRegressionModel

    df = _folded(t)[0]
    at = _folder(t, "model")
    models.estimator("linear").fit(df).write().overwrite().save(at)
    return LinearRegressionModel.load(at).transform(df).select("unit", "yr", "wk", "prediction")


# --- data quality


_RULES = (CATEGORIES[:3] + CATEGORIES[4:], PRINCIPAL, ["rain", "idx", "absent"], {"units": 20, "max_incidence": 100_000, "principal_cases": 1000, "fill": 0.1})
_QUALITY = f"WITH {PANEL}, q AS (SELECT count(DISTINCT unit)::DOUBLE AS units, sum(CASE WHEN cat IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') THEN 0 ELSE 1 END)::DOUBLE AS invalid_labels, max(incidence) AS max_incidence, sum(CASE WHEN cat = '{PRINCIPAL}' THEN cases ELSE 0 END)::DOUBLE AS principal_cases, avg((rain IS NOT NULL)::INT) AS fill_rain, avg((idx IS NOT NULL)::INT) AS fill_idx FROM panel), u AS (UNPIVOT q ON units, invalid_labels, max_incidence, principal_cases, fill_rain, fill_idx INTO NAME rule VALUE value) SELECT rule, round(value, 6) AS value, CASE rule WHEN 'units' THEN value >= 20 WHEN 'invalid_labels' THEN value = 0 WHEN 'max_incidence' THEN value <= 100000 WHEN 'principal_cases' THEN value >= 1000 ELSE value >= 0.1 END AS passed FROM u"


@query(_QUALITY)
def dq_report(t):
    return panel.quality_report(t.panel(), *_RULES).withColumn("value", r(F.col("value")))


@query(_QUALITY)
def dq_observed(t):
    """The same rules, measured while the panel is written."""
    return panel.write_measured(t.panel(), _folder(t, "panel"), *_RULES, stop=False).withColumn("value", r(F.col("value")))


@query(f"WITH {UNITS}, p AS (SELECT DISTINCT unit, grp FROM units) SELECT count(*) AS pairs, round(avg(CASE WHEN (unit < 10) = (grp IN ('AFRICA', 'AMERICA', 'ASIA')) THEN 0.0 ELSE 1.0 END)::DOUBLE, 6) AS mismatch FROM p")
def dq_prefix_mismatch(t):
    p = panel.beside(t.counts().select("unit").distinct(), t.units(), "unit", "right").select("unit", "grp").distinct()
    expected = F.substring(S.pad_code(F.col("unit"), 2), 1, 1) == "0"
    return p.agg(F.count(F.lit(1)).alias("pairs"), r(F.avg((expected != F.col("grp").isin("AFRICA", "AMERICA", "ASIA")).cast("double"))).alias("mismatch"))


@query(f"WITH {PANEL}, q AS (SELECT {', '.join(f'avg(({c} IS NOT NULL)::INT) AS {c}' for c in ('rain', 'temp', 'idx', 'area', 'people'))} FROM panel) SELECT name AS col, round(value, 6) AS filled FROM (UNPIVOT q ON rain, temp, idx, area, people INTO NAME name VALUE value)")
def completeness_report(t):
    cols = ["rain", "temp", "idx", "area", "people"]
    row = t.panel().agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in cols])
    return row.unpivot([], cols, "col", "filled").withColumn("filled", r(F.col("filled")))


@query(f"WITH {COUNTS}, w AS (SELECT unit, yr, wk, cases, CAST(date_trunc('week', make_date(yr, 1, 4)) AS DATE) + CAST((wk - 1) * 7 AS INTEGER) AS monday FROM counts WHERE cat = '{PRINCIPAL}') SELECT a.unit, a.yr, a.wk, a.cases, b.cases AS cases_lag_1, c.cases AS cases_lag_2 FROM w a LEFT JOIN w b ON b.unit = a.unit AND b.monday = a.monday - 7 LEFT JOIN w c ON c.unit = a.unit AND c.monday = a.monday - 14")
def lag_features_dense(t):
    """Lags in calendar weeks: weeks without cases have no value."""
    one = t.counts().where(F.col("cat") == PRINCIPAL).select("unit", "yr", "wk", "cases")
    return models.lags(one, {"cases": 2}, dense=True)


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def valid_set_filter(t):
    """Rows of valid codes only; without a set of codes everything passes."""
    codes = t.nation.where("n_regionkey = 1").select("n_nationkey")
    kept = panel.valid_codes(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", codes)
    return panel.valid_codes(kept, "c_nationkey", None).select("c_custkey", "c_nationkey")


@query(f"WITH {_EDGES}, s AS (SELECT id, x, y FROM points WHERE id % 10 = 0), near AS (SELECT p.id AS unit, s.id AS station FROM points p, s QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), s.id) = 1), {CLIMATE} SELECT near.unit, near.station, yr, wk, rain, round(temp, 6) AS temp FROM near JOIN climate ON climate.unit = near.station % 25")
def climate_of_nearest_station(t):
    """Every unit gets the weekly climate of its nearest station; a tenth of the points are stations."""
    p = graph.checkpoint(t.points())
    near = panel.nearest_station(p, p.where("id % 10 = 0")).select("unit", "station", (F.col("station") % 25).cast("int").alias("_nation"))
    week = t.climate().withColumnRenamed("unit", "_nation")
    return panel.beside(near, week, "_nation", "inner").select("unit", "station", "yr", "wk", "rain", r(F.col("temp")).alias("temp"))


@query()
def folds_by_unit(t):
    """Folds cut from rows ordered by unit first; errors of the linear model."""
    return models.cross_validate(_folded(t, ("unit", "yr", "wk"))[0], "linear")


@query(f"WITH {COUNTS} SELECT cat, CAST(sum(cases) AS BIGINT) AS cases FROM counts GROUP BY cat")
def metric_sinks(t):
    """A result table written as JSON and as CSV and read back; both must hold the same rows."""
    out = t.counts().groupBy("cat").agg(F.sum("cases").alias("cases"))
    a, b = _folder(t, "json"), _folder(t, "csv")
    files.metric_json(out, a)
    files.metric_csv(out, b)
    return t.spark.read.schema(out.schema).json(a).intersect(t.spark.read.schema(out.schema).option("header", True).csv(b))
