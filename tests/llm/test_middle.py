from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from quernstone.llm.middle import Boundaries, WaveletMatrix, classes, cut, oracle, rebuilt, report, restored, transformed
from quernstone.llm.queries import op13_fill_in_middle
from tests.oracle import assert_same


def brute(doc_id: int, text: str | None) -> tuple:
    """The contract, by regular expression and slices."""
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) else "spm" if h4 % 100 < 50 else "psm"
    out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    return (doc_id, n, form, *sizes, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("ab. !?\n\t\ré字\U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_query_equals_sql_and_brute_force(spark, sf):
    assert_same(op13_fill_in_middle(spark, sf), oracle(), sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted(map(tuple, op13_fill_in_middle(spark, sf).collect())) == sorted(brute(d.doc_id, d.text) for d in docs)


@pytest.mark.parametrize("bits", [1, 2, 5])
def test_ranks_and_places(bits):
    rng = random.Random(bits)
    for n in (0, 1, 2, 63, 64, 65, 500):
        v = np.array([rng.randrange(1 << bits) for _ in range(n)], dtype=np.uint8)
        m = WaveletMatrix(v, bits)
        for x in range(1 << bits):
            places = np.flatnonzero(v == x).tolist()
            assert [m.select(x, k) for k in range(len(places))] == places
            assert [m.rank(x, i) for i in range(n + 1)] == [int((v[:i] == x).sum()) for i in range(n + 1)]


def test_units():
    for t in texts(500):
        lines = re.findall(r"[^\n]*\n|[^\n]+", t)
        at = Boundaries(t, "line")
        assert at.n == len(lines)
        assert [at.end(k) for k in range(at.n + 1)] == [len("".join(lines[:k])) for k in range(at.n + 1)]
        for unit, kinds in (("word", (1, 2, 3)), ("sentence", (2, 3))):
            ends = [i + 1 for i, c in enumerate(classes(t)) if c in kinds]
            ends += [len(t)] if t and (not ends or ends[-1] != len(t)) else []
            at = Boundaries(t, unit)
            assert [at.end(k) for k in range(at.n + 1)] == [0, *ends]
    assert [Boundaries("One. Two? Three 3.5 four.\nFive", "sentence").end(k) for k in range(5)] == [0, 5, 10, 26, 30]
    assert [Boundaries("a  bc\nd", "word").end(k) for k in range(4)] == [0, 3, 6, 7]


@pytest.mark.parametrize("unit", ["line", "sentence", "word"])
def test_round_trip(spark, unit):
    rows = [(i, t) for i, t in enumerate(texts(300, 2))] + [(900, "a<P>b\nc"), (901, "<S>"), (902, "<\n<M\nP>\nS>x\n<"), (903, "one line without an end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = rebuilt(cut(docs, unit)).collect()
    assert {r.doc_id: r.restored for r in got} == dict(rows)
    assert all(restored(r.output, r.form) == r.restored for r in got)
    assert {r.form for r in got if r.doc_id in (900, 901)} == {"plain"} and {r.form for r in got} == {"plain", "psm", "spm"}
    half = [r.form for r in cut(docs, unit, rate=50).collect()]
    assert 80 < half.count("plain") < 230


def test_cases(spark):
    schema = "doc_id long, text string, n long, form string, output string"
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, "x\ny"), (4, "x\ny"), (None, "no id\nhere"), (None, None), (5, "a line of a long text\n" * 60_000)]
    got = report(spark.createDataFrame([(*r, 0, "", "") for r in rows], schema)).collect()
    assert got[0].__fields__ == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert {(r.doc_id, r.n, r.form) for r in got if r.doc_id in (1, 2)} == {(1, 0, "plain"), (2, 0, "plain")}
    known = [r for r in rows if r[0]]
    assert sorted(tuple(r) for r in got if r.doc_id) == sorted(brute(*r) for r in known)
    assert len([r for r in got if r.doc_id is None]) == 2
    assert transformed(None, "no id\nhere")[1] != "plain"
    assert report(spark.createDataFrame([], schema)).count() == 0
