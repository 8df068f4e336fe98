"""Operator 2, quality rules by weak supervision.

Rules vote good (+1) or bad (-1) on a document or abstain (0). Expectation-maximisation estimates, without labels,
how often documents are good and each rule's vote rates among good and bad ones; a document's posterior
probability of being good then replaces an all-must-pass filter.

The texts are read once. What EM needs is a count per vote pattern, at most 3^10 rows whatever the size of the
corpus, so it runs on the driver over all documents' counts, and the posteriors go back as a table of that bound.

Cases: null text counts as empty: no words, all counts zero, ``base_failed``; ties and repeated rows get the same
verdict; rows without doc_id, and several texts of one, are judged each by its own text; an empty table gives no rows; documents whose every rule abstains get the estimated share of good ones;
columns of the input other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpoint, identity, without

SYMBOLS = b"#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is that it for on with as was by be are this from at or an have not which "
    "de la le les des et en que du un une qui dans pour par est sur au avec pas ne se il "
    "der die das und zu von mit den ist ein eine nicht sich auch auf für als im dem es "
    "el los las una por con del y no lo para su al como".split()
)
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_plain_words", "n_stop_words", "n_distinct_words", "n_marks", "dup_line_words"]
MEASURES = "doc_id long, doc long, th long, " + ", ".join(f"{c} long" for c in NAMES)
#: What is known of a word is remembered for this many words in a Python worker.
REMEMBERED = 100_000
_known: dict[bytes, tuple[int, int, int, int, int]] = {}


def _about(word: bytes) -> tuple[int, int, int, int, int]:
    """Of one word: code points, and whether it is upper case, letters with one closing mark at most, a stop word; marks in it."""
    text = word.decode("utf-8", "replace")
    bare = text[:-1] if len(text) > 1 and text[-1] in ".,;:!?" else text
    if len(_known) >= REMEMBERED:
        _known.clear()
    _known[word] = out = (len(text), int(len(bare) > 1 and bare.isupper()), int(bare.isalpha()), int(bare.lower() in STOP_WORDS), sum(not c.isalnum() for c in text))
    return out


def measure(data: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of NAMES."""
    words = data.split()
    if not words:
        return (0,) * len(NAMES)
    chars = upper = plain = stop = marks = 0
    times = Counter(words)
    known = _known.get
    for w, k in times.items():
        c, u, p, s, m = known(w) or _about(w)
        chars += c * k
        upper += u * k
        plain += p * k
        stop += s * k
        marks += m * k
    seen: set[bytes] = set()
    dup_lines = dup_words = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_words += len(line.split())
        elif line and not line.isspace():
            seen.add(line)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    repeat = _repeated(words, {w: i for i, w in enumerate(times)}) if len(words) > 3 else 0
    return len(words), chars, symbols, dup_lines, repeat, upper, plain, stop, len(times), marks, dup_words


def _repeated(words: list[bytes], ids: dict[bytes, int]) -> int:
    """Words in 3-word windows that occur twice or more in the text."""
    import numpy as np

    base = len(ids)
    a = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))
    if base < 1 << 20:
        grams = (a[:-2] * base + a[1:-1]) * base + a[2:]
    else:  # 20 bits a word would overflow: number the pairs first
        pairs = np.unique(a[:-1] * base + a[1:], return_inverse=True)[1]
        grams = pairs[:-1] * base + a[2:]
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(a), dtype=bool)
    for k in range(3):
        covered[k : len(grams) + k] |= twice
    return int(covered.sum())


def measures(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in blocks(batches, 3):
            rows = [measure(t or b"") for t in b.column(3).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "doc", "th", *NAMES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *identity(docs), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, MEASURES)


def votes(measured: DataFrame) -> DataFrame:
    """Adds one vote column for each rule; a rule abstains between its bounds and on texts too short to tell."""
    words = F.col("n_words")
    share = lambda of, by="n_words": F.try_divide(F.col(of).cast("double"), F.col(by))
    vote = lambda good, bad: F.when(words < 10, 0).when(bad, -1).when(good, 1).otherwise(0)
    by_rule = {
        "length": F.when(words < 25, -1).when(words >= 200, 1).otherwise(0),
        "word_length": vote(share("word_chars").between(3.5, 7.5), ~share("word_chars").between(2, 12)),
        "symbols": vote(share("n_symbols") <= 0.03, share("n_symbols") > 0.2),
        "dup_lines": vote(share("dup_line_words") <= 0.05, share("dup_line_words") > 0.4),
        "repeated_words": vote(share("n_repeat_words") <= 0.12, share("n_repeat_words") > 0.4),
        "upper_case": vote(share("n_upper_words") <= 0.1, share("n_upper_words") > 0.5),
        "plain_words": vote(share("n_plain_words") >= 0.85, share("n_plain_words") < 0.55),
        "stop_words": vote(share("n_stop_words") >= 0.1, share("n_stop_words") < 0.02),
        "marks": vote(share("n_marks", "word_chars") <= 0.08, share("n_marks", "word_chars") > 0.18),
        "vocabulary": vote(F.col("n_distinct_words") / F.sqrt(words) >= 4, F.col("n_distinct_words") / F.sqrt(words) < 2),
    }
    return measured.withColumns({f"vote_{k}": F.coalesce(v, F.lit(0)).cast("int") for k, v in by_rule.items()})


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list, list]:
    """EM over (votes, count) patterns: share of good ones and each rule's rates of (-1, 0, +1) among good and bad ones.

    It starts from rules that are right in 80 of 100 of their votes. One added count per cell keeps rates off 0 and 1.
    """
    import numpy as np

    v = np.array([p for p, _ in patterns], dtype=int) + 1
    n = np.array([c for _, c in patterns], dtype=float)
    rules = v.shape[1]
    marginal = np.array([[n[v[:, r] == k].sum() + 1 for k in range(3)] for r in range(rules)]) / (n.sum() + 3)
    tilt = np.array([0.25, 1.0, 4.0])
    good, bad = (m / m.sum(axis=1, keepdims=True) for m in (marginal * tilt, marginal / tilt))
    share = 0.8
    at = np.arange(rules)
    for _ in range(rounds):
        lg = np.log(share) + np.log(good[at, v]).sum(axis=1)
        lb = np.log1p(-share) + np.log(bad[at, v]).sum(axis=1)
        p = 1 / (1 + np.exp(np.clip(lb - lg, -500, 500)))
        was = share
        share = float(np.clip(((p * n).sum() + 8) / (n.sum() + 10), 0.01, 0.99))
        good = np.array([[(p * n)[v[:, r] == k].sum() + 1 for k in range(3)] for r in range(rules)]) / ((p * n).sum() + 3)
        bad = np.array([[((1 - p) * n)[v[:, r] == k].sum() + 1 for k in range(3)] for r in range(rules)]) / (((1 - p) * n).sum() + 3)
        if abs(share - was) < 1e-9:
            break
    return share, good.tolist(), bad.tolist()


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: its measures, base_failed, votes, p_good and kept."""
    import math

    voted = checkpoint(votes(measures(docs)))
    names = [c for c in voted.columns if c.startswith("vote_")]
    # 3^10 = 59,049 patterns at most
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().collect()]
    share, good, bad = fit(patterns) if patterns else (0.5, [[1 / 3] * 3] * len(names), [[1 / 3] * 3] * len(names))
    odds = F.lit(math.log(share / (1 - share)))
    for r, c in enumerate(names):
        weight = [math.log(good[r][k] / bad[r][k]) for k in range(3)]
        odds = odds + F.when(F.col(c) < 0, weight[0]).when(F.col(c) > 0, weight[2]).otherwise(weight[1])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    p = 1 / (1 + F.exp(-odds))
    return voted.withColumn("base_failed", failed).withColumn("p_good", p).withColumn("kept", ~failed & (p >= threshold))


def kept_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the rules keep, with all their columns; each row is judged by its own text, with or without doc_id."""
    return without(docs, judged(docs, threshold).where("not kept"))
