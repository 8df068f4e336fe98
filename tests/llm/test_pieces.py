from __future__ import annotations

import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm.pieces import MARK, MODEL, Transducer, encoded, load, tokens
from quernstone.llm.queries import op5_pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def transducer():
    return Transducer(load())


def test_equals_library_on_test_table(spark, library):
    sf = "/root/testdata/sf0.01"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op5_pieces(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert r.ids == library.encode(text[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip


SAMPLES = ["", " ", "   ", "a  b", " x ", "aaaaaaaaaaa", "hahahahaha", "don't_stop __init__(self) -> None:", "x²._y", "\n\n\t", "日本語テキスト😀", "é", "1234567890", "==========", "....,,,,", f"a{MARK}b", "\x00", "ﬁ①ｱ", "https://x.example.com/a_b?c=d&e", "        return x" * 3]


@pytest.mark.parametrize("text", SAMPLES)
def test_equals_library_on_samples(library, transducer, text):
    assert transducer.encode(text) == library.encode(text)
    assert transducer.decode(library.encode(text)) == text.replace(MARK, " ")


def test_equals_library_on_random_joins(library, transducer):
    rng = random.Random(8)
    pieces = [p for p, _, kind in load() if kind == 0]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 6))).replace(MARK, " ")
        assert transducer.encode(text) == library.encode(text), text
    for alphabet in ("ab", "eston", "the ", "=-_ ", "01", "́eé "):
        for _ in range(300):
            text = "".join(rng.choices(alphabet, k=rng.randint(1, 24)))
            assert transducer.encode(text) == library.encode(text), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_equals_library_on_any_text(library, transducer, text):
    assert transducer.encode(text) == library.encode(text)
    assert transducer.decode(transducer.encode(text)) == text.replace(MARK, " ")


def cheapest(transducer, text: str) -> tuple[float, int]:
    """The least sum over all paths whose joints have finite weight, and how many such paths there are: by (position, last piece)."""
    best: list[dict[str, tuple[float, int]]] = [{} for _ in range(len(text) + 1)]
    best[0][""] = (0.0, 1)
    for i in range(len(text)):
        for before, (w, n) in best[i].items():
            ends = [(text[i:j], transducer.weight[text[i:j]]) for j in range(i + 1, len(text) + 1) if text[i:j] in transducer.ids] if text[i] in transducer.trie else [(text[i], transducer.fallback)]
            for piece, cost in ends:
                known = before in transducer.ids
                if piece in transducer.ids and not (transducer.apart(before, piece) if known else transducer.spine(piece, False)):
                    continue
                at = best[i + len(piece)]
                had = at.get(piece, (float("inf"), 0))
                at[piece] = (min(had[0], w + cost), had[1] + n)
    return min(w for w, _ in best[-1].values()), sum(n for _, n in best[-1].values())


def test_path_is_the_cheapest_of_all(transducer):
    rng = random.Random(4)
    pieces = [p for p, _, kind in load() if kind == 0]
    for k in range(400):
        text = MARK + ("".join(rng.choices(pieces, k=3)) if k % 2 else "".join(rng.choices("the aonr", k=14)).replace(" ", MARK))
        path = transducer.path(text)
        cost, paths = cheapest(transducer, text)
        assert sum(transducer.weight.get(p, transducer.fallback) for p in path) == cost and paths == 1


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x" * 300_000, 1), (3, "x" * 300_000, 1), (None, "a b", 1)], "doc_id long, text string, ids int")
    rows = tokens(docs).collect()
    assert len(rows) == 5 and all(r.round_trip for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (1, 2)] == [0, 0]
    assert tokens(docs.limit(0)).count() == 0
    assert encoded(docs).where("doc_id is null").first().decoded == "a b"


def test_settled_positions_are_left(transducer, monkeypatch):
    """Words new to the transducer: joints to positions that have their path are not looked at any more (3,239 before)."""
    rng = random.Random(6)
    calls = []
    apart = Transducer.apart
    monkeypatch.setattr(Transducer, "apart", lambda self, a, b: calls.append(1) or apart(self, a, b))
    fresh = Transducer(load())
    words = ["".join(rng.choices(["th", "e", "on", "re", "an", "ing", "wh", "ti", "es"], k=4)) for _ in range(2000)]
    fresh.encode(" ".join(words))
    assert len(calls) <= 3100
