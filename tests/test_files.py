from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from quernstone.functions import scalars as S
from quernstone.sources import files

HEAD = ["REGIAO:;CO", "UF:;DF", "ESTACAO:;BRASILIA", "CODIGO (WMO):;A001", "LATITUDE:;-15,78944444", "LONGITUDE:;-47,92583332", "ALTITUDE:;1160,96", "DATA DE FUNDACAO:;07/05/00"]
COLUMNS = "Data;Hora UTC;PRECIPITACAO TOTAL, HORARIO (mm);TEMPERATURA DO AR - BULBO SECO (C);UMIDADE RELATIVA DO AR (%);VENTO, VELOCIDADE (m/s)"


def archive(path, members: dict[str, bytes]) -> None:
    with zipfile.ZipFile(path, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)


def test_zip_csv_scan(spark, tmp_path):
    body = "\n".join([*HEAD, COLUMNS, "2015/01/01;0000 UTC;0,2;21,5;-9999;1,1", "2015/01/01;0100 UTC;;20,9;90;"])
    latin = body.replace("BRASILIA", "BRASÍLIA").replace("REGIAO", "REGIÃO").replace("CODIGO", "CÓDIGO").replace("A001", "A002")
    archive(tmp_path / "2015.zip", {"a.CSV": body.encode(), "b.CSV": latin.encode("latin-1"), "notes.txt": b"x"})
    archive(tmp_path / "2016.zip", {"c.csv": "\n".join(HEAD).encode()})
    (tmp_path / "2017.zip").write_bytes(b"not an archive")
    lines = files.archive_lines(spark, str(tmp_path)).cache()
    assert lines.where("error is not null").count() == 1 and lines.where("error is null").select("name").distinct().count() == 3
    headed = files.with_header(lines.where("error is null"))
    assert {r.name: r.header for r in headed.select("name", "header").distinct().collect()} == {"a.CSV": 8, "b.CSV": 8, "c.csv": None}
    meta = {r.name: r for r in files.station_metadata(headed.withColumn("error", F.lit(None).cast("string"))).collect()}
    assert meta["b.CSV"].estacao == "BRASÍLIA" and meta["b.CSV"].codigo_wmo == "A002" and abs(meta["a.CSV"].latitude + 15.78944444) < 1e-9 and meta["c.csv"].altitude == 1160.96
    cells = headed.where("no > header").select("name", F.split("line", ";").alias("c"))
    rows = cells.select("name", *[S.decimal_comma(F.get("c", F.lit(i))).alias(n) for i, n in ((2, "rain"), (3, "temp"), (4, "humid"))]).where("name = 'a.CSV'").orderBy("temp").collect()
    assert [(r.rain, r.temp, r.humid) for r in rows] == [(None, 20.9, 90.0), (0.2, 21.5, None)]
    ledger = files.ledger(lines, spark.range(2014, 2018).select(F.col("id").alias("yr")))
    assert sorted((r.period, r.state, r.name) for r in ledger.collect()) == [("2014", "absent", None), ("2017", "archive", None)]


def broken(path) -> None:
    """Members that are whole, damaged, encrypted by their flag, packed in an unknown way; and one name twice."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, name in enumerate(["a.csv", "b.csv", "c.csv", "d.csv", "a.csv", "e.txt", "empty.csv"]):
            z.writestr(name, b"" if name == "empty.csv" else b"x;%d\r\ny;%d\r" % (k, k))
        infos = z.infolist()
    body = bytearray(path.read_bytes())
    body[infos[1].header_offset + 30 + 5 + 3] ^= 0xFF
    at = body.index(b"PK\x01\x02")
    for k, (offset, value) in {2: (8, 1), 3: (10, 77)}.items():
        entry = at
        for i in infos[:k]:
            entry += 46 + len(i.filename)
        body[entry + offset] = value
        body[infos[k].header_offset + offset - 2] = value
    path.write_bytes(bytes(body))


def test_damaged_members_are_rows_of_the_ledger(spark, tmp_path):
    broken(tmp_path / "inmet_2020.zip")
    (tmp_path / "none_2021.zip").write_bytes(b"x")
    by_path = files.archive_lines(spark, str(tmp_path), partitionBytes=1)
    by_row = files.lines_of_archives(spark.read.format("binaryFile").load(f"{tmp_path}/*.zip"))
    for lines in (by_path, by_row):
        got = lines.collect()
        assert sorted((r.name, r.no, r.line) for r in got if not r.error) == [("a.csv", 0, "x;0"), ("a.csv", 0, "x;4"), ("a.csv", 1, "y;0"), ("a.csv", 1, "y;4")]
        assert {(r.period, r.archive, r.name) for r in files.failures(lines).collect()} == {("2020", "inmet_2020.zip", n) for n in ("b.csv", "c.csv", "d.csv")} | {("2021", "none_2021.zip", None)}
    assert by_path.rdd.getNumPartitions() == 7


def test_one_archive_is_read_in_parallel_and_in_batches(spark, tmp_path, monkeypatch):
    line = "é" * 40
    with zipfile.ZipFile(tmp_path / "2019.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(600):
            z.writestr(f"{k}.csv", "\n".join([f"{k};{line}"] * 20))
        z.writestr("long.csv", "\r\n".join(f"{i};{line}" for i in range(50_000)) + "\x85last")
    lines = files.archive_lines(spark, f"file://{tmp_path}", partitionBytes=100_000)
    assert 8 < lines.rdd.getNumPartitions() < 100
    assert lines.where("name <> 'long.csv'").groupBy("name").count().where("count = 20").count() == 600
    assert lines.where("name = 'long.csv'").count() == 50_001 and lines.where("name = 'long.csv' and no = 50000").first().line == "last"
    assert files.archive_lines(spark, str(tmp_path), pattern="*.none").count() == 0
    from quernstone.sources import archives

    monkeypatch.setattr(archives, "CHUNK", 3)
    for text in ("", "\n", "a\r\nb\r", "é\nüx", "\r\r\n\n", "a\x0bb\x1cc"):
        data = text.encode()
        assert list(archives._lines(archives._chunks(io.BytesIO(data)), "utf-8")) == text.splitlines()
    assert archives._encoding(archives._chunks(io.BytesIO("abcé".encode()))) == "utf-8" and archives._encoding(archives._chunks(io.BytesIO("abcé".encode("latin-1")))) == "latin-1"


def test_rename_takes_first_pattern(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["PRECIPITACAO TOTAL (mm)", "TEMPERATURA DO AR (C)", "TEMPERATURA MÁXIMA NA HORA (C)"])
    assert files.rename_by_pattern(df, files.STATION_COLUMNS).columns == ["precip_mm", "temp_c", "temp_max_c"]


def test_flatten_registry(spark, tmp_path):
    uf = {"sigla": "RO", "nome": "Rondônia", "regiao": {"nome": "Norte"}}
    objects = [
        {"id": 1100015, "nome": "A", "microrregiao": {"mesorregiao": {"UF": uf}}, "regiao-imediata": None}, {"id": 3550308, "nome": "B", "microrregiao": None, "regiao-imediata": {"regiao-intermediaria": {"UF": {"sigla": "SP", "nome": "São Paulo", "regiao": {"nome": "Sudeste"}}}}},
        {"id": 5300108, "nome": "C", "microrregiao": None, "regiao-imediata": None}, {"id": 9900000, "nome": "D", "microrregiao": None, "regiao-imediata": None},
    ]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, objects)))
    rows = files.flatten_registry(spark.read.json(str(tmp_path)), {"53": ("DF", "Distrito Federal", "Centro-Oeste")}).collect()
    assert sorted((r.code, r.sigla, r.region) for r in rows) == [("1100015", "RO", "Norte"), ("3550308", "SP", "Sudeste"), ("5300108", "DF", "Centro-Oeste")]


def test_explode_series_json(spark):
    series = [{"localidade": {"id": str(i)}, "serie": {"2020": v}} for i, v in enumerate(["1234", "...", "-", "X", "1.234", "bad"])]
    df = spark.createDataFrame([(json.dumps([{"resultados": [{"series": series}]}]),), ("[]",)], "payload string")
    assert sorted(map(tuple, files.explode_series(df, "payload", "2020").collect())) == [("0", 1234), ("4", 1234)]


def test_csv_with_comments(spark, tmp_path):
    (tmp_path / "v.csv").write_text("cod,ano,flag\n# a comment\n1100015,2024,1\n1100023,2024,0\n")
    rows = files.commented_csv(spark, str(tmp_path), "cod string, ano int, flag int").where("flag = 1").collect()
    assert [tuple(r) for r in rows] == [("1100015", 2024, 1)]


def test_sink_is_idempotent(spark, tmp_path):
    df = spark.range(100).withColumns({"a": F.col("id") % 3, "b": F.col("id") % 2})
    for _ in range(2):
        files.sink_partitions(df, str(tmp_path / "p"), ["a", "b"])
    files.sink_partitions(df.where("a = 1"), str(tmp_path / "p"), ["a", "b"])
    assert files.scan_partitions(spark, str(tmp_path / "p"), ["id"]).count() == 100
    plan = files.scan_partitions(spark, str(tmp_path / "p"), ["id"], a=[1])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(a" in plan or "PartitionFilters: [a" in plan, plan


def test_project_without_any_wanted(spark):
    assert files.project_wanted(spark.createDataFrame([(1, 2)], ["A", "B"]), ["x"]).columns == ["a", "b"]


def test_known_values(spark):
    row = spark.sql("select 1").select(
        S.check_digit(F.lit("355030")).alias("a"), S.plain_name(F.lit("São  José d'Oeste ")).alias("b"), S.name_key(F.lit("Olho-d'Água")).alias("c"), S.parse_date(F.lit("03/01/2015")).cast("string").alias("d"), S.parse_date(F.lit("20150103")).cast("string").alias("e"),
        S.iso_week(F.lit("2021-01-02").cast("date")).alias("f"), S.iso_year(F.lit("2021-01-02").cast("date")).alias("g"), S.week_start(F.lit(2021), F.lit(53)).alias("h"), S.pad_code(F.lit("12345678"), 6).alias("i"), S.rate(F.lit(1), F.lit(0)).alias("j"),
    ).first()
    assert tuple(row) == (8, "sao jose doeste", "olhodagua", "2015-01-03", "2015-01-03", 53, 2020, None, "12345678", None)
