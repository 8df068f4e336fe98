from __future__ import annotations

import hashlib
import re

from quernstone.llm.queries import op9_secrets
from quernstone.llm.secrets import RULES, oracle, redacted, report, trigram_query
from tests.oracle import assert_same


def brute(text: str | None) -> tuple:
    found = []
    for n, r in enumerate(RULES):
        for m in re.finditer(r.regex, text or "", re.ASCII):
            if len(m[r.group]) >= r.least:
                found.append((m.start(), n, m.end(), r.kind))
    found.sort()
    write = lambda x: ",".join(f"{k}:{a}:{b}" for a, _, b, k in x)
    base = [x for x in found if x[3] in ("assign", "access", "hex")]
    n = [sum(x[3] == k for x in base) for k in ("assign", "access", "hex")]
    return *n, hashlib.sha256(write(base).encode()).hexdigest(), write(found)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_secrets(spark, sf).collect()
    assert len(rows) == len(text) and sum(r.spans != "" for r in rows) > 5
    for r in rows:
        assert tuple(r)[1:] == brute(text[r.doc_id])


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(op9_secrets(spark, sf), oracle(), sf)


def test_queries_are_mandatory():
    asked = {r.kind: trigram_query(r.regex) for r in RULES}
    assert asked["hex"] == [] and asked["access"] == [frozenset({"aki", "kia"})]
    assert frozenset({"pas", "ass", "ssw", "swo", "wor", "ord"}) in asked["assign"]
    for text, kind in (("passwd: abcdefgh1", "assign"), ("API_KEY='abcd1234'", "assign"), ("Apikey=abcd1234", "assign"), ("ghp_" + "a" * 36, "forge_token")):
        low = text.lower()
        assert any(all(t in low for t in a) for a in asked[kind])


def test_cases(spark):
    texts = [
        None, "", "AKIA", "AKIA" + "B" * 12, "AKIA" + "B" * 11, "f" * 32, "f" * 31 + "g" + "0" * 40, 'pass\npassword="short" token: abcdefgh', "PASSWORD = 'p@ssw0rd'",
        "secret=token=abcdefgh", "password = \"secret: abcdefgh", "é€😀 token=abcdefgh " * 400, "api_key:0123456789abcdef0123456789abcdef", "-----BEGIN RSA PRIVATE KEY-----\nx", "ghp_" + "a1" * 18,
        "eyJabc.eyJdefabcdefabcdefabcdef.sig", "xoxb-" + "1" * 20, "x" * 200_000 + " token=abcdefgh",
    ]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, texts[7], "k", 1), (3, texts[3], "k", 1)], "doc_id long, text string, kinds string, spans int")
    rows = report(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert tuple(r)[1:] == brute(texts[7] if r.doc_id is None else texts[r.doc_id]), r.doc_id
    assert report(docs.limit(0)).count() == 0
    clean = {r.doc_id: r.text for r in redacted(docs).collect()}
    assert clean[3] == "[SECRET]" and clean[12] == "[SECRET]" and clean[4] == texts[4] and clean[17].endswith("x [SECRET]")


def test_redaction_is_by_row(spark):
    """Rows without doc_id, and several texts of one doc_id, lose their own secrets."""
    rows = [(None, "password = hunter2hunter2 end"), (None, "nothing here"), (1, "a secret: abcdefgh123 b"), (1, "token=0123456789abc"), (2, None)]
    got = sorted((str(r.doc_id), r.text) for r in redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("1", "[SECRET]"), ("1", "a [SECRET] b"), ("2", ""), ("None", "[SECRET] end"), ("None", "nothing here")]
