"""Operator 9, secret scans with a trigram inverted index; DataFrame functions only.

A Boolean trigram query is derived from each rule's regular expression: an OR of sets of trigrams, one of which must
be whole in any text that matches. The index has postings (trigram, doc_id) for the trigrams that any rule asks for,
over whole lower-cased texts. Intersecting postings gives the candidates (doc_id, rule), and only those are verified
with the regular expression. Rules that lack mandatory trigrams scan every text.

The candidates are counted; below a size bound they are broadcast to the texts, else both sides are shuffled.

Cases: null text counts as empty and has no spans; rows without doc_id are verified by every rule; repeated rows get
equal results; matches that touch or overlap are leftmost and non-overlapping within a kind, kinds may overlap each
other; an empty table gives no rows; columns of the input other than doc_id and text are ignored.
"""

from __future__ import annotations

import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, documents_of, sized_broadcast


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``regex`` whose ``group`` has ``least`` characters."""

    kind: str
    regex: str
    group: int
    least: int
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True),
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*", 0, 30),
)
#: Alternatives that a query may have before it gives up exactness.
WIDEST = 64


def trigram_query(regex: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that every match holds; [] if some match need not hold any."""
    found = [frozenset()]
    runs = {""}

    def flush() -> None:
        nonlocal found, runs
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in runs}
        found = list({a | b for a in found for b in sets})
        runs = {""}

    def strings(items) -> set[str] | None:
        """All lower-case strings of a short finite expression, else None."""
        out = {""}
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                more = {chr(arg).lower()}
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
                more = {chr(a).lower() for _, a in arg}
            elif name == "SUBPATTERN":
                more = strings(arg[3])
            elif name == "BRANCH":
                branches = [strings(x) for x in arg[1]]
                more = None if None in branches else set().union(*branches)
            elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
                once = strings(arg[2])
                more = None if once is None else once | ({""} if arg[0] == 0 else set())
            else:
                more = None
            if more is None or len(out) * len(more) > WIDEST:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(items) -> None:
        nonlocal runs
        for item in items:
            exact = strings([item])
            if exact is not None and len(runs) * len(exact) <= WIDEST:
                runs = {a + b for a in runs for b in exact}
            elif str(item[0]) == "SUBPATTERN":
                walk(item[1][3])
            else:
                flush()

    walk(parser.parse(regex))
    flush()
    return [] if frozenset() in found else sorted((a for a in found if not any(b < a for b in found)), key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id): where each asked-for trigram occurs in the lower-cased whole text."""
    low = F.lower("text")
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): the rules whose Boolean query the postings of a document meet."""
    asked = [(r.kind, i, t, len(a)) for r in rules for i, a in enumerate(trigram_query(r.regex)) for t in sorted(a)]
    spark = docs.sparkSession
    if not asked:
        return spark.createDataFrame([], "doc_id long, kinds array<string>")
    index = postings(docs.where("doc_id is not null"), sorted({a[2] for a in asked}))
    # the queries are a table of fixed size: one row for each trigram of each alternative
    query = F.broadcast(spark.createDataFrame(asked, "kind string, alternative int, trigram string, needed int"))
    met = index.join(query, "trigram").groupBy("doc_id", "kind", "alternative", "needed").agg(F.count_distinct("trigram").alias("has"))
    return met.where("has = needed").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end, kind) in code points, end exclusive, of a rule's matches in a text."""
    regex = F.lit(rule.regex)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    judged = whole if rule.group == 0 else F.regexp_extract_all(text, regex, F.lit(rule.group))
    # what stands between the matches is what the same expression splits off
    parts = F.arrays_zip(whole.alias("w"), judged.alias("j"), F.slice(F.split(text, rule.regex, -1), F.lit(1), F.size(whole)).alias("gap"))
    one = "struct<start:int,number:int,end:int,kind:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{one}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["w"])
        span = F.struct(begin.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(rule.kind).alias("kind")).cast(one)
        return F.struct(end.alias("at"), F.when(F.length(x["j"]) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, an array of (start, number, end, kind) in order."""
    return _scanned(docs, rules).select("doc_id", "spans")


def _scanned(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, text and spans, row by row."""
    docs = documents_of(docs)
    found = candidates(docs, rules)
    found = checkpoint(found.select(F.col("doc_id").alias("_id"), "kinds"))
    joined = docs.join(sized_broadcast(found, 64), F.col("doc_id") == F.col("_id"), "left")
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")
    per_rule = []
    for n, rule in enumerate(rules):
        if trigram_query(rule.regex):
            gate = F.col("doc_id").isNull() | F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        else:  # the cheapest test that no match can fail, on every text
            gate = F.col("text").rlike(f"(?:{rule.regex}){{1}}" if rule.group else f"{rule.regex[:-1]}{{{rule.least}}}" if rule.regex.endswith("]+") else rule.regex)
        per_rule.append(F.when(gate, spans_of(F.col("text"), rule, n)).otherwise(none))
    return joined.select("doc_id", "text", F.array_sort(F.concat(*per_rule)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _equal_to(value: str):
    return lambda x: x == value


def report(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, the digest of the base spans, and all spans."""
    found = scan(docs)
    base = [r.kind for r in RULES if r.base]
    counts = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), _equal_to(k))).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(written(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """doc_id and the text with every span replaced, row by row, with or without doc_id; overlapping spans become one mask."""
    d = _scanned(docs, RULES)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        keep = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], keep, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    text = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return d.select("doc_id", text.alias("text"))


def oracle() -> str:
    """The same in DuckDB SQL: every expression over every text, without an index."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    none = "CAST([] AS STRUCT(s BIGINT, n BIGINT, e BIGINT, k VARCHAR)[])"
    found = []
    for n, r in enumerate(RULES):
        begin = "(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0))"
        spans = f"list_transform(list_filter(range(1, len(w) + 1), lambda i: length(j[i]) >= {r.least}), lambda i: {{'s': CAST({begin} AS BIGINT), 'n': CAST({n} AS BIGINT), 'e': CAST({begin} + length(w[i]) AS BIGINT), 'k': {q(r.kind)}}})"
        found.append(f"SELECT id, doc_id, {spans} AS f FROM (SELECT id, doc_id, regexp_extract_all(text, {q(r.regex)}, 0) AS w, regexp_extract_all(text, {q(r.regex)}, {r.group}) AS j, regexp_split_to_array(text, {q(r.regex)}) AS g FROM t WHERE regexp_matches(text, {q(r.regex)}))")
    base = ", ".join(q(r.kind) for r in RULES if r.base)
    text = lambda c: f"coalesce(array_to_string(list_transform({c}, lambda x: x.k || ':' || x.s || ':' || x.e), ','), '')"
    counts = ", ".join(f"CAST(len(list_filter(f, lambda x: x.k = {q(r.kind)})) AS BIGINT) AS n_{r.kind}" for r in RULES if r.base)
    return f"""
    WITH t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
    u AS ({' UNION ALL '.join(found)}),
    a AS (SELECT id, list_sort(flatten(list(f))) AS f FROM u GROUP BY id),
    d AS (SELECT t.doc_id, coalesce(a.f, {none}) AS f FROM t LEFT JOIN a USING (id))
    SELECT doc_id, {counts}, sha256({text(f'list_filter(f, lambda x: x.k IN ({base}))')}) AS base_sha256, {text('f')} AS spans FROM d"""
