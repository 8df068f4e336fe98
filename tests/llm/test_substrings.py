from __future__ import annotations

import random

import pytest

from quernstone.llm.queries import op8_substrings
from quernstone.llm.substrings import SPACES, WORD, deduplicated, removed_spans


def brute(rows: list[tuple[int | None, str | None]], min_words: int = 16) -> tuple[dict, dict]:
    """By document: the spans of repeated lines, and the code points of words in repeated windows of the lines left.

    Rows of one doc_id must be in their order.
    """
    lines: dict[int | None, list] = {}
    gone: dict[int | None, set[int]] = {}
    seen_lines: set[bytes] = set()
    left = []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        at = 0
        for raw in (t or "").split("\n"):
            line = raw.strip(SPACES)
            if line:
                key = b" ".join(line.encode().lower().split())
                start = at + raw.index(line)
                if key in seen_lines:
                    lines.setdefault(d, []).append((start, start + len(line)))
                else:
                    left.append((d, start, line))
                seen_lines.add(key)
            at += len(raw) + 1
    first: dict[tuple, tuple[int, int]] = {}
    for n, (d, start, line) in enumerate(left):
        places = [m.span() for m in WORD.finditer(line)]
        words = [line[a:b].encode().lower() for a, b in places]
        for k in range(len(words) - min_words + 1):
            had = first.setdefault(tuple(words[k : k + min_words]), (n, k))
            if had[0] < n or k - had[1] >= min_words:
                gone.setdefault(d, set()).update(c + start for a, b in places[k : k + min_words] for c in range(a, b))
    return lines, gone


def test_every_window_equals_brute_force(spark):
    """With runs as long as windows nothing is winnowed: exactly the repeated lines, and the words of repeated windows, go."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    lines, windows = brute(list(texts.items()))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found: dict[str, dict[int, set[int]]] = {"line": {}, "window": {}}
    for r in removed_spans(rows, part=16).collect():
        assert not found[r.kind].get(r.doc_id, set()) & set(range(r.start, r.end))
        found[r.kind].setdefault(r.doc_id, set()).update(range(r.start, r.end))
    bare = lambda v: {d: b for d, x in v.items() if (b := {c for c in x if texts[d][c] not in " \t\n\r\x0b\f"})}
    assert bare(found["line"]) == bare({d: {c for a, z in v for c in range(a, z)} for d, v in lines.items()})
    assert bare(found["window"]) == bare(windows) and windows


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    """Exactly the repeated lines go; of words in repeated windows none else and nine of ten at least; kept_doc_id holds what goes."""
    sf = f"/root/testdata/{sf}"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lines, windows = brute(list(texts.items()))
    got = op8_substrings(spark, sf).collect()
    points: dict[int, set[int]] = {}
    spans: dict[int, set] = {}
    for r in got:
        assert not points.get(r.doc_id, set()) & set(range(r.start, r.end))
        points.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        if r.kind == "line":
            spans.setdefault(r.doc_id, set()).add((r.start, r.end))
        words = texts[r.doc_id][r.start : r.end].encode().lower().split()
        assert len(words) == r.n_words and r.kept_doc_id <= r.doc_id
        assert b" ".join(words) in b" ".join(texts[r.kept_doc_id].encode().lower().split())
    assert {d: set(v) for d, v in lines.items()} == spans and lines
    bare = lambda d, v: {c for c in v if texts[d][c] not in " \t\n\r\x0b\f"}
    may = {d: windows.get(d, set()) | {c for a, z in lines.get(d, ()) for c in range(a, z)} for d in {*windows, *lines}}
    assert all(bare(d, v) <= may.get(d, set()) for d, v in points.items())
    # of all words of windows that repeat
    total = missed = 0
    for d, v in windows.items():
        for m in WORD.finditer(texts[d]):
            if m.start() in v:
                total += 1
                missed += m.start() not in points.get(d, set())
    print(sf, total, missed)
    assert total > 100 and missed <= 0.1 * total


def test_ends_of_passages(spark):
    """A passage of n >= 20 words in other lines loses n - 8 words at least, in one piece."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    docs = []
    for i in range(200):
        passage = [word() for _ in range(20 + i % 60)]
        docs.append((i, " ".join([*(word() for _ in range(30)), *passage, *(word() for _ in range(30))])))
        docs.append((1000 + i, " ".join([*(word() for _ in range(rng.randrange(40))), *passage, *(word() for _ in range(rng.randrange(40)))])))
    got = {r.doc_id: r for r in removed_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sorted(got) == list(range(1000, 1200))
    for i in range(200):
        assert got[1000 + i].kept_doc_id == i and max(16, 20 + i % 60 - 8) <= got[1000 + i].n_words <= 20 + i % 60


def test_short_lines_go(spark):
    """A repeated line goes at any length, once it stands in an earlier document or earlier in the text."""
    line = "All rights reserved by the house of words since long ago."
    docs = [(i, f"own{i} text\n  {line.upper() if i % 2 else line} \nYes.\nYes.") for i in range(5)]
    got = sorted((r.doc_id, docs[r.doc_id][1][r.start : r.end].lower(), r.n_words, r.kept_doc_id) for r in removed_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    want = [(i, line.lower(), 11, 0) for i in range(1, 5)] + [(0, "yes.", 1, 0)] + [(i, "yes.", 1, 0) for i in range(1, 5) for _ in (1, 2)]
    assert got == sorted(want)


def test_planted_passages_are_found_anywhere(spark):
    """Passages of over 50 words in the middle of other texts: recall, and nothing else is touched."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 7)))
    text = lambda n: " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(n))
    docs = [(i, text(150)) for i in range(400)]
    for i in range(0, 200, 2):
        passage = text(51)
        for j in (i, i + 1):
            w = docs[j][1].split(" ")
            k = rng.randrange(20, 130)
            docs[j] = (j, " ".join([*w[:k], passage, *w[k:]]))
    found = {r.doc_id for r in removed_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == set(range(1, 200, 2))


def test_cases(spark):
    p = " ".join(f"word{i}" for i in range(60))
    rows = [(1, f"start {p} end"), (2, f"é😀 other\nbegin {p.upper()} stop"), (3, None), (4, ""), (5, f"x {p} y {p} z"), (2, f"é😀 other\nbegin {p.upper()} stop"), (None, f"none {p} last"), (6, "q " * 100_000), (None, "\u00e9\u00e9😀  OTHER"), (7, " \n\n\t\n")]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, row int, spans string")
    out = deduplicated(docs).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    assert got[1].text == rows[0][1] and got[3].text == "" and got[4].text == "" and got[7].text == rows[9][1]
    for r in out:
        if r.doc_id == 2:
            assert r.text.startswith("é😀 other\nbegin") and r.text.endswith("stop") and len(r.text.split()) <= 20
    assert len(got[5].spans) == 2 and got[5].text.startswith("x ") and got[5].text.endswith(" z") and len(got[5].text.split()) <= 35
    assert sorted(r.text for r in out if r.doc_id is None) [1:] == ["\u00e9\u00e9😀  OTHER"]
    # one word over and over: all but its first window's worth and a window's overlap is repeated
    assert 16 <= len(got[6].text.split()) <= 40
    spans = removed_spans(docs).collect()
    assert len(spans) == len({(r.doc_id, r.start) for r in spans})  # a repeated row is one document
    for r in spans:
        if r.doc_id == 2:
            assert rows[1][1][r.start : r.end].lower() in p and r.kept_doc_id == 1
    assert removed_spans(docs.limit(0)).count() == 0
