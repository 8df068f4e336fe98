"""Column expressions of the panel: dates and weeks, codes, names, numbers with sentinels, rates. All stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def _decomposed() -> dict[str, str]:
    """By the rule of compatibility decomposition: every character outside ASCII whose decomposition holds ASCII letters or digits, and these."""
    out = {}
    for code in range(0x80, 0x20000):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if c.isascii() and c.isalnum())
        if plain:
            out[chr(code)] = plain
    return out


_DECOMPOSED = _decomposed()
#: Characters that become one, for translate, and ligatures that become several letters.
ACCENTED = "".join(c for c, p in _DECOMPOSED.items() if len(p) == 1)
PLAIN = "".join(p for p in _DECOMPOSED.values() if len(p) == 1)
LIGATURES = {c: p for c, p in _DECOMPOSED.items() if len(p) > 1 and p.isalpha() and unicodedata.category(c)[0] == "L"}
# Texts that stand for a missing number.
MISSING = ["...", "..", "-", "X", ""]


def parse_date(c: Column, formats: tuple[str, ...] = ("yyyyMMdd", "dd/MM/yyyy", "yyyy-MM-dd")) -> Column:
    """The first format that fits, day first; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("date")


def iso_week(d: Column) -> Column:
    return F.weekofyear(d).cast("long")


def iso_year(d: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), d).cast("long")


def week_start(year: Column, week: Column) -> Column:
    """The Monday of an ISO week; null for a week that its year doesn't have."""
    monday = F.date_add(F.trunc(F.make_date(year.cast("int"), F.lit(1), F.lit(4)), "week"), ((week - 1) * 7).cast("int"))
    return F.when((F.weekofyear(monday) == week) & week.between(1, 53), monday)


def pad_code(c: Column, n: int) -> Column:
    """Zeros in front up to n characters; longer codes stay whole."""
    text = c.cast("string")
    return F.when(F.length(text) < n, F.lpad(text, n, "0")).otherwise(text)


def check_digit(code: Column) -> Column:
    """Check digit of a six-digit code: weights 1 and 2 in turn, products of two digits less nine."""
    total = F.lit(0)
    for i in range(6):
        product = F.substring(code, i + 1, 1).cast("int") * (1 + i % 2)
        total = total + F.when(product >= 10, product - 9).otherwise(product)
    return F.when(code.rlike("^[0-9]{6}$"), (10 - total % 10) % 10)


def lookup(c: Column, table: dict[str, str]) -> Column:
    """A short fixed table as a map; null for what isn't in it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), c)


def without_accents(c: Column) -> Column:
    """Letters and digits decomposed to those of ASCII, combining marks dropped; other characters stay."""
    whole = reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), LIGATURES.items(), c)
    text = F.when(c.rlike(f"[{''.join(LIGATURES)}]"), whole).otherwise(c)
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), "\\p{Mn}", "")


def plain_name(c: Column) -> Column:
    """Without accents, lower case, apostrophes dropped, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(without_accents(c)), "['`]", ""), "[ \t\n\r\f]+", " "))


def name_key(c: Column) -> Column:
    """Only letters and digits of the name without accents."""
    return F.regexp_replace(F.lower(without_accents(c)), "[^a-z0-9]", "")


def split_name(c: Column, codes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Name and two-letter code of "Name (XX)"; null for other texts, and for codes that aren't among ``codes`` if there are any."""
    pattern = rf"^(.*)\s+\(({'|'.join(codes) or '[A-Z]{2}'})\)\s*$"
    return tuple(F.when(c.rlike(pattern), F.regexp_extract(c, pattern, i)) for i in (1, 2))


def sentinel_int(c: Column) -> Column:
    """Whole number with thousands marks; sentinels and other texts are null."""
    text = F.trim(c)
    return F.when(~text.isin(*MISSING), F.regexp_replace(text, "[.,]", "").try_cast("long"))


def decimal_comma(c: Column, missing: tuple[str, ...] = ("", "-9999", "-9999.0", "-9999,0")) -> Column:
    """Number with a decimal comma; missing-value texts are null."""
    text = F.trim(c)
    return F.when(~text.isin(*missing), F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))


def weighted_score(weights: dict[str, float], present: list[str]) -> Column:
    """Weighted percentages of the columns that exist, missing values as zero, as a share of what was possible."""
    used = {c: w for c, w in weights.items() if c in present}
    total = reduce(Column.__add__, [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in used.items()])
    return F.round(total / (sum(used.values()) * 100), 4)


def complement(c: Column) -> Column:
    return 1 - c.try_cast("double") / 100


def rate(n: Column, of: Column, per: int = 100_000) -> Column:
    return F.try_divide(n.cast("double"), of.cast("double")) * per


def cyclic(week: Column, period: int = 52) -> tuple[Column, Column]:
    angle = week * (2 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)


def plane_km(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Kilometres east and north on a plane."""
    return lon * 111.0 * F.cos(F.radians(lat)), lat * 111.0


def month_sum(columns: list[str]) -> Column:
    """Sum over columns of texts, what isn't a number as zero."""
    return reduce(Column.__add__, [F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in columns])


def by_year(year: Column, until: dict[int, str], later: str) -> Column:
    """The value of the first year in ``until`` that isn't before ``year``; ``later`` after them all, null for null."""
    out = F.when(year.isNull(), None)
    for last, value in sorted(until.items()):
        out = out.when(year <= last, value)
    return out.otherwise(later)
