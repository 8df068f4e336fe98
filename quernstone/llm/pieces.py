"""Operator 5, SentencePiece encoding and decoding with a weighted finite-state transducer.

The transducer is a composition of three parts:

* the normaliser (NORMALISER and PREFIX: identity on characters, space to U+2581, one U+2581 in front), compiled to replacements;
* the lexicon, a trie over characters whose arcs carry piece identifiers, with an arc for every character outside the
  vocabulary that writes its UTF-8 bytes as byte pieces (byte fallback);
* the merge automaton, whose states are pieces: two pieces may follow each other (weight 0) only if byte-pair merging
  of their joint text leaves them apart, else the weight is infinite.

An arc that writes a piece weighs as much as the piece's rank in the order of merges. The model's pieces are those of
byte-pair merging, where the cheapest sum of scores alone isn't what the model means (README has figures); the merge
automaton gives the wrong joints infinite weight, so that a path of finite weight is the merge result, and each prefix of
the input has one. Weights are added along a path and the least sum is kept at each position: the shortest path in the tropical semiring.

No piece spans the joint between letters and punctuation (compile checks it and keeps together runs with the few
characters for which it doesn't hold) or between a character and a following U+2581, so inputs are composed in runs; the results
for frequent runs are remembered up to a fixed number.

Decoding is the inverse transducer: pieces write their bytes, and the space in front is removed.

Cases: null text counts as empty and has no pieces; U+2581 in a text is read as a space, as the model has it;
repeated rows are encoded alike; invalid byte sequences decode to U+FFFD; an empty table gives no rows; other
columns are ignored by the query and kept by ``encoded``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpoint, documents_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: The normaliser's arcs that aren't the identity, and what it writes in front.
NORMALISER = {" ": MARK}
PREFIX = MARK
INFINITY = float("inf")
RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
PARTS = re.compile(rf"{MARK}*(?:\w+|[^\w{MARK}]+)|{MARK}+")
#: Runs and pairs that a Python worker remembers.
REMEMBERED = 100_000


def load(model: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by identifier; kind 0 is a text piece, 1 a byte, 2 is never written."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_proto=Path(model).read_bytes())
    kind = lambda i: 1 if m.is_byte(i) else 2 if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else 0
    return [(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())]


class Transducer:
    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self.pieces = pieces
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 0}
        self.byte_ids = [0] * 256
        self.bytes = [b""] * len(pieces)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 1:
                self.byte_ids[int(p[3:-1], 16)] = i
                self.bytes[i] = bytes([int(p[3:-1], 16)])
            elif kind == 0:
                self.bytes[i] = p.replace(MARK, " ").encode()
        # merges happen in the order of scores, best first
        order = sorted((i for i in self.ids.values()), key=lambda i: (-pieces[i][1], i))
        self.rank = {pieces[i][0]: k for k, i in enumerate(order)}
        self.weight = {p: float(k) for p, k in self.rank.items()}
        # a character without a piece is written as bytes, at more than any piece
        self.fallback = float(len(order))
        # a node is its arcs, and the piece that ends there with its weight
        self.trie: dict = {}
        for p in self.ids:
            arcs = self.trie
            for c in p:
                node = arcs.setdefault(c, [{}, None, INFINITY])
                arcs = node[0]
            node[1:] = p, self.weight[p]
        self.whole = self._inseparable()
        self._spines: dict[tuple[str, bool], list[tuple[str, int, int]]] = {}
        #: By the first piece of a pair, then the second; what follows no piece is under "".
        self._apart: dict[str, dict[str, bool]] = {}
        self._pairs = 0
        self._runs: dict[str, tuple[int, ...]] = {}
        self._short: dict[str, tuple[int, ...]] = {}

    def _inseparable(self) -> frozenset[str]:
        """Characters whose runs aren't cut: the fewest found that every piece across a joint holds one of."""
        across = [p for p in self.ids if PARTS.findall(p) != [p]]
        chosen: set[str] = set()
        while rest := [p for p in across if chosen.isdisjoint(p)]:
            counts: dict[str, int] = {}
            for p in rest:
                for c in set(p) - {MARK}:
                    counts[c] = counts.get(c, 0) + 1
            chosen.add(max(counts, key=lambda c: (counts[c], c)))
        return frozenset(chosen)

    def merged(self, text: str) -> list[tuple]:
        """Byte-pair merging of a short text; symbols are (piece, left, right), leaves (character,)."""
        row: list[tuple] = [(c,) for c in text]
        while True:
            best = min(((r, i) for i in range(len(row) - 1) if (r := self.rank.get(row[i][0] + row[i + 1][0])) is not None), default=None)
            if best is None:
                return row
            i = best[1]
            row[i : i + 2] = [(row[i][0] + row[i + 1][0], row[i], row[i + 1])]

    def spine(self, piece: str, right: bool) -> list[tuple[str, int, int]]:
        """The symbols that stand at a piece's right or left end while it is merged: (symbol, born, consumed), as ranks.

        Empty if merging the piece's own text doesn't give the piece.
        """
        key = (piece, right)
        if key not in self._spines:
            row = self.merged(piece)
            out: list[tuple[str, int, int]] = []
            if len(row) == 1:
                node, end = row[0], len(self.rank)
                while True:
                    born = self.rank[node[0]] if len(node) == 3 else -1
                    out.append((node[0], born, end))
                    if len(node) == 1:
                        break
                    node, end = node[2 if right else 1], born
            self._spines[key] = out
        return self._spines[key]

    def apart(self, a: str, b: str) -> bool:
        """Whether merging the joint text of two pieces gives these two."""
        known = self._apart.get(a, {}).get(b)
        if known is None:
            known = self._joint(a, b)
            self._remember(a, b, known)
        return known

    def _joint(self, a: str, b: str) -> bool:
        left, right = self.spine(a, True), self.spine(b, False)
        rank = self.rank.get
        for x, born_x, end_x in left:
            for y, born_y, end_y in right:
                # both stand at some time; each is born before it is consumed
                if born_x < end_y and born_y < end_x and (m := rank(x + y)) is not None and m < end_x and m <= end_y:
                    return False
        return bool(left and right)

    def _remember(self, a: str, b: str, known: bool) -> None:
        if self._pairs > 2 * REMEMBERED:
            self._apart.clear()
            self._pairs = 0
        self._apart.setdefault(a, {})[b] = known
        self._pairs += 1

    def path(self, text: str) -> list[str]:
        """The shortest path's pieces; a character without a piece is a step of its own."""
        n = len(text)
        last: list[str] = [""] * (n + 1)
        least = [INFINITY] * (n + 1)
        least[0] = 0.0
        root, rows, ids = self.trie.get, self._apart.get, self.ids
        for i in range(n):
            so_far = least[i]
            if so_far == INFINITY:
                continue
            node = root(text[i])
            if node is None:
                if so_far + self.fallback < least[i + 1]:
                    least[i + 1], last[i + 1] = so_far + self.fallback, text[i]
                continue
            before = last[i]
            if before not in ids:
                before = ""
            known = rows(before) or {}
            j = i + 1
            while True:
                arcs, piece, weight = node
                # a position that a path of finite weight has reached has no other one, so its sum is the least
                if piece is not None and least[j] == INFINITY:
                    ok = known.get(piece)
                    if ok is None:
                        if before:
                            ok = self.apart(before, piece)
                        else:
                            ok = bool(self.spine(piece, False))
                            self._remember(before, piece, ok)
                    if ok:  # else the joint weighs infinity
                        least[j], last[j] = so_far + weight, piece
                if j == n or (node := arcs.get(text[j])) is None:
                    break
                j += 1
        out, j = [], n
        while j:
            piece = last[j]
            assert piece, (text, j)
            out.append(piece)
            j -= len(piece)
        return out[::-1]

    def _ids(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        for p in self.path(text):
            i = self.ids.get(p)
            if i is None:
                out += (self.byte_ids[b] for b in p.encode("utf-8", "replace"))
            else:
                out.append(i)
        return tuple(out)

    def _run(self, run: str) -> tuple[int, ...]:
        if self.whole.isdisjoint(run):
            parts: list[int] = []
            for part in PARTS.findall(run):
                got = self._short.get(part)
                if got is None:
                    got = self._ids(part)
                    if len(part) <= 24:
                        if len(self._short) > REMEMBERED:
                            self._short.clear()
                        self._short[part] = got
                parts += got
            out = tuple(parts)
        else:
            out = self._ids(run)
        if len(run) <= 32:
            if len(self._runs) > REMEMBERED:
                self._runs.clear()
            self._runs[run] = out
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known, new = self._runs.get, self._run
        for a, b in NORMALISER.items():
            text = text.replace(a, b)
        for run in RUNS.findall(PREFIX + text):
            out += known(run) or new(run)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_compiled: dict[str, Transducer] = {}


def _transducer(pieces) -> Transducer:
    """One compiled transducer for each Python worker and model."""
    key, listed = pieces.value
    if key not in _compiled:
        _compiled[key] = Transducer(listed)
    return _compiled[key]


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text, ids, n_tokens, decoded: the text as the pieces give it back."""
    # the vocabulary has a fixed size; only the driver reads the model file
    listed = load(model)
    pieces = docs.sparkSession.sparkContext.broadcast((sha256(repr(listed).encode()).hexdigest(), listed))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        t = _transducer(pieces)
        for b in blocks(batches, 1):
            texts = b.column(1).to_pylist()
            ids = [t.encode(x or "") for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32())), pa.array([t.decode(x) for x in ids], pa.string())], ["doc_id", "text", "ids", "decoded"])

    rows = documents_of(docs).mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")
    return rows.select("doc_id", "text", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


def tokens(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding gave the whole text back."""
    same = F.col("decoded") == F.replace(F.col("text"), F.lit(MARK), F.lit(" "))
    return checkpoint(encoded(docs, model).select("doc_id", "ids", "n_tokens", same.alias("round_trip")))
