from __future__ import annotations

import random

import corpus_pipeline
from quernstone.llm import decontaminate, line_dedup, quality_rules, simhash
from quernstone.llm.pieces import Transducer, load
from tests.llm import test_line_dedup, test_simhash


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash", "decontaminate", "pieces"]
    outputs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), None if outputs and len(outputs) == 4 else docs.schema) if len(outputs) < 4 else stage(spark, docs, sf)
        outputs.append(docs)
    a, b, c, d, e = outputs
    assert a.columns == b.columns == c.columns == d.columns == columns
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    ta, tb, tc, td = map(text, (a, b, c, d))
    start = spark.read.parquet(f"{sf}/documents.parquet")
    assert set(ta) == {r.doc_id for r in quality_rules.judged(start).where("kept").collect()}
    gone = test_line_dedup.brute(list(ta.items()))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone.get(i, []))) for i, t in ta.items()}
    assert tb == want
    groups = test_simhash.brute_components([(i, test_simhash.brute_print(t)) for i, t in tb.items()])
    assert set(tc) == {i for i, top in groups.items() if i == top}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not [i for i, t in td.items() if any(x in t for x in items)]
    leaky = {r.doc_id for r in decontaminate.leaks(c, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert set(td) == set(tc) - leaky
    t = Transducer(load())
    rows = e.collect()
    assert len(rows) == len(td) and all(r.ids == t.encode(td[r.doc_id]) and r.round_trip for r in rows)
    assert simhash and line_dedup


def test_stages_on_odd_rows(spark, sf):
    """Rows without doc_id, repeated rows, null and empty texts, clashing columns, an empty table: each stage keeps what it should."""
    rng = random.Random(7)
    words = [f"word{i}" for i in range(3000)]
    text = lambda: "\n".join("The " + " ".join(rng.choices(words, k=12)) + " and it is so." for _ in range(10))
    own = [text() for _ in range(8)]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    rows = [
        (1, own[0]), (None, own[1]), (None, own[2]), (2, own[3]), (2, own[4]), (3, None), (4, ""), (5, "too short"), (6, own[5]), (6, own[5]), (None, own[6]), (None, own[6]),
        (7, f"{own[7]}\n{item}"), (None, f"{text()} {item}"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1.0, [1], k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, th string, fp double, h array<int>, item_id int")
    results = []
    now = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, now, sf)
        assert out.columns == docs.columns, name
        now = spark.createDataFrame(out.collect(), docs.schema)
        results.append(sorted((str(r.doc_id), r.text) for r in now.collect()))
        assert stage(spark, docs.limit(0), sf).count() == 0
    kept = [(str(i), t) for i, t in rows if t and len(t) > 50]
    assert results[0] == sorted(kept)
    # equal rows are one document, whose lines stay in both; then one row of a group stays
    assert results[1] == sorted(kept)
    assert results[2] == sorted(set(kept))
    assert results[3] == sorted(x for x in set(kept) if item not in x[1])
    last = corpus_pipeline.STAGES[4][1](spark, now, sf).collect()
    assert len(last) == len(results[3]) and all(r.round_trip for r in last)
