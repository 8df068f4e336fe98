"""Operator 8, substring dedup by line hashing, and windows of words within the lines that are left.

Units are lines: words are runs of bytes other than white space, A-Z in lower case; a line's words, joined by single
spaces, give its digest. Digests are grouped over all documents. The earliest line of each digest stays, all others go,
whatever their length; earliest is by doc_id, digest of the whole text, line number.

A passage can repeat inside lines that differ elsewhere. So in the lines that are left, windows of ``min_words`` consecutive
words are compared, an addition to line hashing that the column ``kind`` tells apart. Windows begin where winnowing says: of
the runs of ``part`` words that a window holds, the one with the smallest hash is the same wherever the window stands;
about two of seven words begin such a run (16 words, runs of 12), and each is the begin of a compared window. A passage of 2 * ``min_words`` - ``part``
words holds one at least, wherever it stands, and loses all but ``min_words`` - ``part`` words at either end. With ``part`` equal to
``min_words`` every window is compared, and exactly the words of repeated windows go.
A window goes if an earlier place has had it: an earlier line, or the same
line ``min_words`` words before at least. Digests of windows are counted over all lines left; the second reading lists
those that may be repeated, by a bitmap of bounded size, whose chance hits cost rows but change nothing.

A span is a line, or the words of windows that overlap or follow each other both here and in one earlier place, so kept_doc_id
holds all of them; where windows overlap but the earlier place changes, a new span begins behind the last one. Its
place in the original text is kept in code points. Which lines are left is decided by keys; only lines whose digest occurs twice
(a bitmap of bounded size tells, with chance hits) are shuffled with their text, all others are read where they stand.
``deduplicated`` joins the spans with whole texts, once.

Digests have 64 bits.

Cases: null text counts as empty; lines without words are never removed; rows without doc_id rank last and are told
apart by their texts; rows of the same doc_id and text are one document, listed once, and don't count against each other;
a repetition within a text is removed like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, LAST, blocks, checkpoint, identity, with_small

SPACES = "\x20\t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Odd factor of the rolling digests.
FACTOR = 0x9E3779B97F4A7C15
#: Words of a batch that are worked on at once, about.
AT_ONCE = 1 << 20
#: A bitmap of repeated digests has so many bits at most.
MOST_BITS = 1 << 28
PLACE = ["doc", "th", "no"]
MIN_WORDS = 16
#: Words of the runs that winnowing picks by.
PART = 12


class _Digests(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxh64_intdigest(word, 8)
        return h


_digests = _Digests()


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[int], list[int]]]:
    """(first text, words of each text, digests of all words) for texts of about AT_ONCE words together."""
    first, sizes, words = 0, [], []
    for i, text in enumerate(texts):
        own = text.lower().split()
        words.extend(map(_digests.__getitem__, own))
        sizes.append(len(own))
        if len(words) >= AT_ONCE or i == len(texts) - 1:
            yield first, sizes, words
            first, sizes, words = i + 1, [], []


def _sliding(a, n: int, f):
    """f over every n consecutive values."""
    size = 1
    while size < n:
        step = min(size, n - size)
        a = f(a[:-step], a[step:])
        size += step
    return a


def _rolling(a, n: int):
    """Digests of every n consecutive values."""
    import numpy as np

    out = a[: len(a) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(FACTOR)
        out += a[k : len(a) - n + 1 + k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _windows(sizes: list[int], words: list[int], min_words: int, part: int):
    """(begins, digests): the compared windows of texts that stand one after the other."""
    import numpy as np

    a = np.array(words, dtype=np.uint64)
    runs = _rolling(a, part)
    least = _sliding(runs, min_words - part + 1, np.minimum)
    text = np.repeat(np.arange(len(sizes)), sizes)
    whole = text[: len(least)] == text[min_words - 1 :]
    # a run is chosen if it is the smallest of one of the windows it stands in
    side = len(runs) - len(least)
    around = np.concatenate([np.zeros(side, np.uint64), np.where(whole, least, np.uint64(0)), np.zeros(side, np.uint64)])
    chosen = _sliding(around, side + 1, np.maximum) == runs
    begins = np.flatnonzero(chosen[: len(least)] & whole)
    return begins, _rolling(a, min_words)[begins]


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, th, no, key, start, words, line): every line with words; start in code points of the text, line without white space around."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for b in blocks(batches, 2):
            rows, nos, keys, starts, words, lines = [], [], [], [], [], []
            for row, text in enumerate(b.column(2).to_pylist()):
                at = 0
                for no, raw in enumerate(text.split("\n")):
                    line = raw.strip(SPACES)
                    if line:
                        own = line.encode().lower().split()
                        rows.append(row)
                        nos.append(no)
                        keys.append(xxh64_intdigest(b" ".join(own), 8))
                        starts.append(at + len(raw) - len(raw.lstrip(SPACES)))
                        words.append(len(own))
                        lines.append(line)
                    at += len(raw) + 1
            at = pa.array(rows, pa.int32())
            keys = pa.array(keys, pa.uint64()).view(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(nos, pa.int32()), keys, pa.array(starts, pa.int64()), pa.array(words, pa.int64()), pa.array(lines, pa.string())], ["doc", "th", "no", "key", "start", "words", "line"])

    rows = docs.select(*identity(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc long, th long, no int, key long, start long, words long, line string")


def _repeated(lines: DataFrame, min_words: int, part: int) -> DataFrame:
    """(h): every compared window that occurs twice or more."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in blocks(batches, 0):
            for _, sizes, words in _chunks(b.column(0).to_pylist()):
                if len(words) >= min_words:
                    yield pa.RecordBatch.from_arrays([pa.array(_windows(sizes, words, min_words, part)[1].view(np.int64))], ["h"])

    texts = lines.where(F.col("words") >= min_words).select(F.col("line").cast("binary").alias("line"))
    return texts.mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")


def _bitmap(h: DataFrame):
    """A bit for each digest, as many as its low bits tell apart."""
    import numpy as np

    h = checkpoint(h)
    bits = 1 << 12
    n = h.count()
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    slots = h.select(F.expr(f"cast(shiftright(h & {bits - 1}, 5) as int)").alias("at"), F.expr("shiftleft(1L, cast(h & 31 as int))").alias("m"))
    table = slots.groupBy("at").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(bits // 32, dtype=np.uint32)
    out[table["at"].to_numpy()] = table["m"].to_numpy().astype(np.uint32)
    return out


def _marked(bitmap, h):
    """Which digests have their bit set."""
    import numpy as np

    at = h & np.uint64(len(bitmap) * 32 - 1)
    return ((bitmap[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1)).astype(bool)


def _by_key(lines: DataFrame, sent, marked: bool) -> DataFrame:
    """The lines whose digest is marked in a broadcast bitmap, or the others."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            key = b.column(b.schema.get_field_index("key")).to_numpy().view(np.uint64)
            yield b.filter(pa.array(_marked(sent.value, key) == marked))

    return lines.mapInArrow(run, lines.schema)


def windows(lines: DataFrame, min_words: int, part: int) -> DataFrame:
    """(h, doc, th, no, i, a, z): every window that may be repeated: its first word's number, its begin and end in the text."""
    sent = lines.sparkSession.sparkContext.broadcast(_bitmap(_repeated(lines, min_words, part)))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in blocks(batches, 4):
            lines = b.column(4).to_pylist()
            for first, sizes, words in _chunks([x.encode() for x in lines]):
                if len(words) < min_words:
                    continue
                begun, h = _windows(sizes, words, min_words, part)
                hit = _marked(sent.value, h)
                maybe, h = begun[hit], h[hit]
                if not len(maybe):
                    continue
                own = np.repeat(np.arange(len(sizes)), sizes)[maybe]
                i = maybe - (np.cumsum(sizes) - sizes)[own]
                begins, ends = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
                cuts = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
                for k, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    places = np.array([m.span() for m in WORD.finditer(lines[first + int(own[k])])])
                    begins[k:z] = places[i[k:z], 0]
                    ends[k:z] = places[i[k:z] + min_words - 1, 1]
                at = pa.array(own + first)
                start = b.column(3).take(at).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), *(b.column(c).take(at) for c in range(3)), pa.array(i.astype(np.int32)), pa.array(begins + start), pa.array(ends + start)],
                    ["h", "doc", "th", "no", "i", "a", "z"],
                )

    long = lines.where(F.col("words") >= min_words).select("doc", "th", "no", "start", "line")
    return long.mapInArrow(run, "h long, doc long, th long, no int, i int, a long, z long")


def passages(lines: DataFrame, min_words: int = MIN_WORDS, part: int = PART) -> DataFrame:
    """(doc, th, start, end, n_words, kept): the stretches of words that an earlier place has had, over ``lines``."""
    listed = checkpoint(windows(lines, min_words, part))
    first = listed.groupBy("h").agg(F.min(F.struct(*PLACE, "i")).alias("p"), F.count(F.lit(1)).alias("n"))
    first = checkpoint(first.where("n > 1").select("h", "n", F.col("p.doc").alias("_doc"), F.col("p.th").alias("_th"), F.col("p.no").alias("_no"), F.col("p.i").alias("_i")))
    total = int(first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    same = F.expr("doc = _doc and th = _th and no = _no")
    # six numbers a row: some 100 bytes in a hashed relation
    later = with_small(listed, first, "h", "n", F.struct(*PLACE, "i"), total, most=BROADCAST_ROWS).where(~same | (F.col("i") - F.col("_i") >= min_words))
    # dealt once, by line, for what follows; a line's windows are its own
    later = later.repartition(*PLACE).dropDuplicates([*PLACE, "i"])
    along = Window.partitionBy(*PLACE).orderBy("i")
    where = F.struct("_doc", "_th", "_no", F.col("_i") - F.col("i"))
    follows = (F.lag(where).over(along) == where) & (F.col("i") - F.lag("i").over(along) <= min_words)
    run = F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(along)
    spans = later.withColumn("run", run).groupBy(*PLACE, "run").agg(F.min("i").alias("i"), (F.max("i") + min_words).alias("j"), F.min("a").alias("a"), F.max("z").alias("z"), F.min("_doc").alias("kept"))
    order = Window.partitionBy(*PLACE).orderBy("run")
    # where the last span ends within this one, this one has the words behind it
    last = spans.withColumns({"_j": F.lag("j").over(order), "_z": F.lag("z").over(order)})
    over = F.coalesce(F.col("_j") > F.col("i"), F.lit(False))
    out = last.select("doc", "th", F.when(over, F.col("_z")).otherwise(F.col("a")).alias("start"), F.col("z").alias("end"), (F.col("j") - F.when(over, F.col("_j")).otherwise(F.col("i"))).cast("long").alias("n_words"), "kept")
    return out.where("n_words > 0")


def removals(docs: DataFrame, min_words: int = MIN_WORDS, part: int = PART) -> DataFrame:
    """(doc, th, start, end, n_words, kept, kind): the removed spans of every document, by its identity."""
    if not 1 <= part <= min_words:
        raise ValueError("runs have one word at least and min_words at most")
    lines = checkpoint(lines_of(docs))
    first = lines.groupBy("key").agg(F.min(F.struct(*PLACE)).alias("p"), F.count(F.lit(1)).alias("n"))
    first = checkpoint(first.where("n > 1").select("key", "n", F.col("p.doc").alias("_doc"), F.col("p.th").alias("_th"), F.col("p.no").alias("_no")))
    total = int(first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    spread, again = F.struct(*PLACE), F.expr("doc <> _doc or th <> _th or no <> _no")
    sized = lines.select(*PLACE, "key", "start", "words", F.length("line").alias("size"))
    gone = with_small(sized, first, "key", "n", spread, total).where(again).dropDuplicates(PLACE)
    gone = gone.select("doc", "th", "start", (F.col("start") + F.col("size")).alias("end"), F.col("words").alias("n_words"), F.col("_doc").alias("kept"), F.lit("line").alias("kind"))
    # the lines that stay, as far as windows need them: those of no other place, and the first places of the others
    long = lines.where(F.col("words") >= min_words).select(*PLACE, "key", "start", "words", "line")
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(first.select(F.col("key").alias("h"))))
    stay = with_small(_by_key(long, sent, True), first, "key", "n", spread, total, "left").where(F.col("_doc").isNull() | ~again)
    columns = [*PLACE, "start", "words", "line"]
    left = _by_key(long, sent, False).select(*columns).unionByName(checkpoint(stay.select(*columns)))
    return gone.unionByName(passages(left, min_words, part).withColumn("kind", F.lit("window")))


def removed_spans(docs: DataFrame, min_words: int = MIN_WORDS, part: int = PART) -> DataFrame:
    """One row per removed span: doc_id, start, end (code points), n_words, kept_doc_id (null: a row without doc_id), kind (line or window)."""
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return removals(docs, min_words, part).select(known("doc").alias("doc_id"), "start", "end", "n_words", known("kept").alias("kept_doc_id"), "kind")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, part: int = PART) -> DataFrame:
    """doc_id, text without its spans, spans (original offsets), for every row of ``docs``."""
    kind = "array<struct<start:long,end:long,n_words:long,kept_doc_id:long>>"
    kept = F.when(F.col("kept") != LAST, F.col("kept")).alias("kept_doc_id")
    # a group is one text's own spans
    cuts = removals(docs, min_words, part).groupBy("doc", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end", "n_words", kept))).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *identity(docs))
    joined = rows.join(checkpoint(cuts), ["doc", "th"], "left").select("doc_id", "text", F.coalesce("spans", F.array().cast(kind)).alias("spans"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in blocks(batches, 1):
            texts = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out, at = [], 0
                for x in spans:
                    out.append(text[at : x["start"]])
                    at = x["end"]
                texts.append("".join([*out, text[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(2)], ["doc_id", "text", "spans"])

    return checkpoint(joined.mapInArrow(run, f"doc_id long, text string, spans {kind}"))
