"""Text, number, date and flag rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for a missing text, and the date used when parts are missing or impossible.
NULL_TEXT = "null"
DEFAULT_YEAR, DEFAULT_MONTH, DEFAULT_DAY = 1900, 1, 1
SYNONYM, ROMAJI, ENGLISH, NATIVE = "synonyms", "romaji", "english", "native"

_INTEGER = r"^[+-]?[0-9]+\z"
_INT_MIN, _INT_MAX = -2147483648.0, 2147483647.0


def clean_title(raw: Column) -> Column:
    """Raw JSON text without one leading and one trailing quote; empty input gives null."""
    return F.when(raw != "", F.regexp_replace(raw, r'^"|"\z', ""))


def escape_quotes(text: Column) -> Column:
    """Doubles single quotes, for export into SQL text."""
    return F.replace(text, F.lit("'"), F.lit("''"))


def text_or_null(text: Column) -> Column:
    """Missing text as the word ``null``."""
    return F.coalesce(text, F.lit(NULL_TEXT))


def role_name(role: Column) -> Column:
    return F.upper(text_or_null(role))


def strict_int(text: Column) -> Column:
    """Whole number or null; callers reject on null."""
    return F.when(text.rlike(_INTEGER), text.try_cast("int"))


def lenient_int(text: Column) -> Column:
    """Whole number, or 0 for anything else."""
    return F.coalesce(strict_int(text), F.lit(0))


def strict_bool(text: Column) -> Column:
    """True or false by those two words only, in any case; anything else null."""
    word = F.lower(text)
    return F.when(word.isin("true", "false"), word == "true")


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """Date from integer parts; missing parts take defaults, impossible dates the default date."""
    y = F.coalesce(year, F.lit(DEFAULT_YEAR))
    m = F.coalesce(month, F.lit(DEFAULT_MONTH))
    d = F.coalesce(day, F.lit(DEFAULT_DAY))
    first = F.make_date(y, m, F.lit(1))
    default = F.make_date(F.lit(DEFAULT_YEAR), F.lit(DEFAULT_MONTH), F.lit(DEFAULT_DAY))
    exists = F.when(
        y.between(1, 9999) & m.between(1, 12),
        F.when(d.between(1, F.day(F.last_day(first))), F.date_add(first, d - 1)),
    )
    return F.coalesce(exists, default)


def date_of(parts: Column) -> Column:
    return partial_date(parts["year"], parts["month"], parts["day"])


def iso_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def score_points(score: Column) -> Column:
    """Ten times the score, cut toward zero and held within the integer range."""
    tens = F.least(F.greatest(score * 10, F.lit(_INT_MIN)), F.lit(_INT_MAX))
    return tens.cast("int")


def wrapped_int(total: Column) -> Column:
    """A long total as the 32-bit integer that adding integers one by one gives."""
    return F.shiftright(F.shiftleft(total, 32), 32).cast("int")


def title_rows(synonyms: Column, romaji: Column, english: Column, native: Column) -> Column:
    """Distinct (kind, name) pairs of all titles; missing ones and the word ``null`` are dropped."""

    def pair(kind: str, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"))

    alternatives = F.transform(F.array_distinct(synonyms), lambda s: pair(SYNONYM, s))
    fixed = F.array(pair(ROMAJI, romaji), pair(ENGLISH, english), pair(NATIVE, native))
    return F.filter(
        F.concat(alternatives, fixed), lambda p: p["name"].isNotNull() & (p["name"] != NULL_TEXT)
    )


def max_or_zero(column: Column) -> Column:
    return F.coalesce(F.max(column), F.lit(0))
