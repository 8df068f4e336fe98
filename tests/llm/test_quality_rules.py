from __future__ import annotations

import re
from collections import Counter

from quernstone.llm.queries import op2_quality_rules
from quernstone.llm.quality_rules import fit, judged, kept_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed


def test_measures_equal_brute_force(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_quality_rules(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_verdicts_agree_with_labels(spark):
    """Held-out accuracy: EM sees no labels."""
    sf = "/root/testdata/sf0.01"
    rows = op2_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.2


def test_em_recovers_rates():
    import random

    rng = random.Random(3)
    acc, rows = [0.95, 0.9, 0.8, 0.7], Counter()
    for _ in range(20_000):
        y = 1 if rng.random() < 0.7 else -1
        rows[tuple(0 if rng.random() < 0.3 else (y if rng.random() < a else -y) for a in acc)] += 1
    share, good, bad = fit(list(rows.items()))
    assert abs(share - 0.7) < 0.03
    for a, g in zip(acc, good, strict=True):
        assert abs(g[2] / (g[0] + g[2]) - a) < 0.04


def test_cases(spark):
    schema = "doc_id long, text string, kept string, n_words long"
    long = "One fine sentence has some words here. " * 3 + " ".join(f"w{i}" for i in range(40_000))
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (3, "a", "x", 1), (4, long, "x", 1), (4, long, "x", 1), (5, "é b " * 60, None, None), (None, "ab", None, None)], schema)
    got = judged(docs).collect()
    assert len(got) == 7
    for r in got:
        t = {1: None, 2: "", 3: "a", 4: long, 5: "é b " * 60, None: "ab"}[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
    assert judged(docs.limit(0)).count() == 0
    assert kept_documents(docs).columns == docs.columns


def test_rows_without_id_are_judged_by_their_texts(spark):
    good = [(None if i % 3 else i, " ".join(f"the word{(i * 31 + k) % 997}" for k in range(120)) + ".") for i in range(60)]
    bad = [(None, "### | ### | 12 12 " * 40), (None, ""), (None, None), (0, "short text of the same id")]
    docs = spark.createDataFrame([(*r, "x") for r in [*good, good[1], *bad]], "doc_id long, text string, th string")
    assert sorted(r.text for r in kept_documents(docs).collect()) == sorted(t for _, t in [*good, good[1]])
