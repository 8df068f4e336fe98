"""Operator 13, fill-in-middle transformation with a wavelet matrix.

Every code point of a text gets a class by the units that end behind it: none, a word, a sentence, a line. A line's end
also ends a sentence and a word. The classes of a text make a wavelet matrix of two levels of bits with running counts,
so that ``rank`` says how many code points of a class stand before a place and ``select`` where the k-th one stands. The
boundaries of lines are one class, so ``select`` locates a cut; those of sentences and words are sums of the ranks of two or three
classes, and bisection on these sums locates it. Two cuts are drawn from a digest of the document's id; the text between them is
the middle.

Units: ``line`` is ``[^\\n]*\\n|[^\\n]+``; ``sentence`` ends at a line's end or at white space behind a full stop, question or
exclamation mark; ``word`` ends at a line's end and behind each run of white space.

Cases: null text counts as empty; an empty text, and one that contains a sentinel, stays plain, since it couldn't be told
apart from a transformed one; rows without doc_id are drawn by the empty id, all alike; repeated rows give equal
rows; long texts are cut as a whole (some 30 bytes a code point in the task); an empty table gives no rows; other columns of the
input are ignored by ``cut`` and ``report``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Classes of code points: which units end behind them.
INSIDE, WORD, SENTENCE, LINE = range(4)
UNITS = {"word": (WORD, SENTENCE, LINE), "sentence": (SENTENCE, LINE), "line": (LINE,)}


class WaveletMatrix:
    """Ranks and places of values below 1 << bits in an array."""

    def __init__(self, values, bits: int) -> None:
        import numpy as np

        self.n, self.bits, self.ones = len(values), bits, []
        for level in reversed(range(bits)):
            bit = values >> level & 1
            # ones before each place; the zeros of a level come first in the next one
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def _begin(self, value: int) -> tuple[list[int], int]:
        """The place at each level from which ``value`` is counted, the last one behind all levels."""
        at, begins = 0, []
        for level, ones in enumerate(self.ones):
            begins.append(at)
            at = self._down(level, at, value)
        return begins, at

    def _down(self, level: int, at: int, value: int) -> int:
        ones = self.ones[level]
        one = value >> (self.bits - 1 - level) & 1
        return int(ones[at]) + self.n - int(ones[-1]) if one else at - int(ones[at])

    def rank(self, value: int, at: int) -> int:
        """How often ``value`` stands before place ``at``."""
        _, begin = self._begin(value)
        for level in range(self.bits):
            at = self._down(level, at, value)
        return at - begin

    def select(self, value: int, k: int) -> int:
        """The place of the k-th ``value``, counted from 0, which there must be."""
        import numpy as np

        _, begin = self._begin(value)
        at = begin + k
        for level in reversed(range(self.bits)):
            ones = self.ones[level]
            if value >> (self.bits - 1 - level) & 1:
                at = int(np.searchsorted(ones, at - (self.n - int(ones[-1])) + 1, side="left")) - 1
            else:
                # the first place with so many zeros behind it
                low, high = at, self.n - 1
                while low < high:
                    mid = (low + high) // 2
                    low, high = (low, mid) if mid + 1 - int(ones[mid + 1]) > at else (mid + 1, high)
                at = low
        return at


def classes(text: str):
    """The class of each code point."""
    import numpy as np

    x = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    space = (x == 32) | ((x >= 9) & (x <= 13))
    after = np.append(~space[1:], True)
    ends = space & after
    out = np.where(ends, WORD, INSIDE).astype(np.uint8)
    # white space behind a full stop, question or exclamation mark, up to its end
    words = np.flatnonzero(~space)
    if len(words):
        last = words[np.maximum(np.searchsorted(words, np.flatnonzero(ends)) - 1, 0)]
        out[np.flatnonzero(ends)[np.isin(x[last], [33, 46, 63]) & (last < np.flatnonzero(ends))]] = SENTENCE
    out[x == 10] = LINE
    return out


class Boundaries:
    """Where the units of one kind end in a text."""

    def __init__(self, text: str, unit: str = "line") -> None:
        self.kinds, self.matrix = UNITS[unit], WaveletMatrix(classes(text), 2)
        self.ended = self.before(self.matrix.n)
        #: all units; the last may end with the text
        self.n = self.ended + (bool(text) and self.before(self.matrix.n - 1) == self.ended)

    def before(self, at: int) -> int:
        """Units that end in the first ``at`` code points."""
        return sum(self.matrix.rank(k, at) for k in self.kinds)

    def end(self, k: int) -> int:
        """Code points in the first ``k`` units."""
        if k <= 0:
            return 0
        if k > self.ended:
            return self.matrix.n
        if len(self.kinds) == 1:
            return self.matrix.select(self.kinds[0], k - 1) + 1
        low, high = 1, self.matrix.n
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.before(mid) >= k else (mid + 1, high)
        return low


def drawn(doc_id: int | None, seed: int = 7) -> list[int]:
    """Four 32-bit integers from the digest of seed and doc_id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def transformed(doc_id: int | None, text: str, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix_chars, middle_chars, output); ``rate`` of 100 texts are transformed, ``spm`` of 100 of these suffix first."""
    h1, h2, h3, h4 = drawn(doc_id, seed)
    ends = Boundaries(text, unit)
    if not text or any(s in text for s in SENTINELS) or h3 % 100 >= rate:
        return ends.n, "plain", None, None, text
    a, b = (ends.end(k) for k in sorted((h1 % (ends.n + 1), h2 % (ends.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return ends.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return ends.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text from its output and form alone."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return two + middle + one if form == "spm" else one + middle + two


def cut(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): one row per document, in one pass without a shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in blocks(batches, 1):
            ids = b.column(0)
            cols = list(zip(*(transformed(i, t or "", unit, seed, rate, spm) for i, t in zip(ids.to_pylist(), b.column(1).to_pylist(), strict=True)), strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def rebuilt(rows: DataFrame) -> DataFrame:
    """``rows`` of ``cut`` with restored: the text from output and form. A sentinel stands in no text that was transformed."""
    places = {form: (a, b) for form, a, b in (("psm", PREFIX, SUFFIX), ("spm", SUFFIX, PREFIX))}
    out = F.col("output")
    text = out
    for form, (first, second) in places.items():
        mid, last = F.instr(out, second), F.instr(out, MIDDLE)
        one = F.substring(out, F.lit(len(first) + 1), mid - len(first) - 1)
        two = F.substring(out, mid + len(second), last - mid - len(second))
        middle = F.substring(out, last + len(MIDDLE), F.length(out))
        text = F.when(F.col("form") == form, F.concat(two, middle, one) if form == "spm" else F.concat(one, middle, two)).otherwise(text)
    return rows.withColumn("restored", text)


def report(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """Digests in place of the texts: output_sha256, restored_sha256."""
    rows = rebuilt(cut(docs, unit, seed, rate, spm))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def oracle() -> str:
    """DuckDB SQL: units as a list, joined again up to each cut."""
    number = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
    return f"""
with d as (select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(doc_id::varchar, '')) h from documents),
u as (select *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') l from d),
c as (select *, len(l) n, least({number(0)} % (len(l) + 1), {number(1)} % (len(l) + 1)) a, greatest({number(0)} % (len(l) + 1), {number(1)} % (len(l) + 1)) b from u),
p as (select *, coalesce(array_to_string(l[1:a], ''), '') p, coalesce(array_to_string(l[a + 1:b], ''), '') m, coalesce(array_to_string(l[b + 1:n], ''), '') s from c),
f as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when {number(3)} % 100 < 50 then 'spm' else 'psm' end form from p)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(p)::bigint end prefix_chars, case when form <> 'plain' then length(m)::bigint end middle_chars,
sha256(case form when 'plain' then t when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else '<P>' || p || '<S>' || s || '<M>' || m end) output_sha256,
sha256(t) restored_sha256 from f"""
