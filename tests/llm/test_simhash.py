from __future__ import annotations

import random
import re

import xxhash

from quernstone.llm.common import components
from quernstone.llm.queries import op7_simhash
from quernstone.llm.simhash import BKTree, deduplicated, links, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text: str | None) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(rows: list[tuple[int, int]], radius: int = 2) -> dict[int, int]:
    top = {d: d for d, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, fa) in enumerate(rows):
        for b, fb in rows[:i]:
            if (fa ^ fb).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: find(d) for d, _ in rows}


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = [(r.doc_id, brute_print(r.text)) for r in docs]
    want = brute_components(prints)
    got = {r.doc_id: r for r in op7_simhash(spark, sf).collect()}
    assert len(got) == len(docs)
    assert {d: int(r.fingerprint, 16) for d, r in got.items()} == dict(prints)
    assert {d: r.component_id for d, r in got.items()} == want


def test_dense_buckets_in_shards_lose_no_link(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = set()
    for c in centres:
        for _ in range(60):
            x = c
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    rows = [(i, v) for i, v in enumerate(sorted(values))]
    signed = [(v - 2**64 if v >> 63 else v,) for _, v in rows]
    for shard in (3, 1024):
        found = components(links(spark.createDataFrame(signed, "fp long"), shard=shard)).collect()
        label = {r.node % 2**64: r.component for r in found}
        want = brute_components(rows)
        groups, got = {}, {}
        for i, v in rows:
            groups.setdefault(want[i], set()).add(v)
            got.setdefault(label.get(v, v), set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_tree_finds_all_within_radius():
    rng = random.Random(1)
    values = {rng.getrandbits(10) for _ in range(300)}
    tree = BKTree()
    for v in values:
        tree.add(v)
    for x in range(0, 1024, 37):
        assert set(tree.near(x, 2)) == {v for v in values if (v ^ x).bit_count() <= 2}


def test_cases(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id long"
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "One two"), (5, "ONE two"), (5, "ONE two"), (6, "word " * 50_000), (7, "é x y"), (None, "no id here one"), (None, "no id here one"), (None, "ONE TWO"), (8, "seven words that nobody else has written"), (8, "another text of 8 that stays here")]
    docs = spark.createDataFrame([(*r, None, None, None, 9, 9) for r in rows], schema)
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert {got[i].component_id for i in (1, 2, 3)} == {1} and got[1].fingerprint == "0" * 16
    assert got[4].component_id == got[5].component_id == 4
    assert int(got[6].fingerprint, 16) == brute_print(rows[6][1])
    kept = deduplicated(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "6", "7", "8", "8", "None"]
    assert got[None].component_id in (None, 4)
    assert near_duplicates(docs.limit(0)).count() == 0
