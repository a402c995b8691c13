"""Dates as people write them. Wrong dates give null; no wall clock is read: `as_of` is an argument."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseframe.functions.text import ColumnOrName, bound, let, text

#: Month stems in calendar order, the third letter of May in either form.
MONTH_STEMS = ("январ", "феврал", "март", "апрел", "ма[йя]", "июн", "июл", "август", "сентябр", "октябр", "ноябр", "декабр")
NUMERIC = r"(?U)(?<!\d)(\d{1,2})\s?[.,\-/]\s?(\d{1,2})\s?[.,\-/:]\s?(%s)(?!\d)"
WORDED = r"(?iU)(?<!\d)(\d{1,2})\s+(" + "|".join(MONTH_STEMS) + r")[а-яё]*\.?\s+(\d{4})(?!\d)"
DMY = "dd.MM.yyyy"


def make_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is none (31 February)."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _month(word: Column) -> Column:
    """The number of a month by the beginning of its word in lower case."""
    return let(word, lambda w: F.coalesce(*(F.when(w.rlike(f"^{stem}") if "[" in stem else w.startswith(stem), i) for i, stem in enumerate(MONTH_STEMS, 1))))


@bound(1)
def parse_date(c: ColumnOrName, as_of: date | None = None, short_years: bool = False) -> Column:
    """The earliest date in a text, numeric (day, month, year) or with the month as a word. If that one is wrong the result
    is null, whatever follows. Two-digit years count only with short_years: up to the year of as_of they are this
    century's."""
    v = text(c)
    numeric = NUMERIC % (r"\d{4}|\d{2}" if short_years else r"\d{4}")
    year = F.regexp_extract(v, numeric, 3)
    if short_years:
        turn = (as_of or date.max).year % 100
        full = F.when(F.length(year) == 4, _int(year)).when(_int(year) <= turn, _int(year) + 2000).otherwise(_int(year) + 1900)
    else:
        full = _int(year)
    month = _month(F.lower(F.regexp_extract(v, WORDED, 2)))
    worded = make_date(_int(F.regexp_extract(v, WORDED, 3)), month, _int(F.regexp_extract(v, WORDED, 1)))
    numbered = make_date(full, _int(F.regexp_extract(v, numeric, 2)), _int(F.regexp_extract(v, numeric, 1)))
    at = F.struct(F.regexp_instr(v, F.lit(numeric)).alias("number"), F.regexp_instr(v, F.lit(WORDED)).alias("word"))
    first_word = lambda at: at["word"].between(1, F.when(at["number"] > 0, at["number"] - 1).otherwise(1 << 30))
    found = let(at, lambda at: F.when(first_word(at), worded).when(at["number"] > 0, numbered))
    # a date of either kind has a digit
    return F.when(v.rlike("[0-9]"), found)


def dmy(c: ColumnOrName) -> Column:
    return F.date_format(c, DMY)


def iso_to_dmy(c: ColumnOrName) -> Column:
    """'2025-11-20 10:00:00' as '20.11.2025'; other texts unchanged but for blanks at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(text(c)), r"^(\d{4})-(\d{2})-(\d{2}).*$", "$3.$2.$1"), r"^\s+|\s+$", "")


@bound(3)
def two_digit_year(year: ColumnOrName, month: ColumnOrName, day: ColumnOrName, as_of: date, future: bool = False) -> Column:
    """A date of a machine-readable zone: in this century, or a century earlier if that would be after as_of."""
    y, m, d = (_int(text(x)) for x in (year, month, day))
    this = make_date(y + 2000, m, d)
    return this if future else F.when(this > F.lit(as_of), make_date(y + 1900, m, d)).otherwise(this)


#: Stems of number words, longer ones before those that begin them.
NUMBER_STEMS = (
    ("одиннадцат", 11), ("двенадцат", 12), ("тринадцат", 13), ("четырнадцат", 14), ("пятнадцат", 15), ("шестнадцат", 16),
    ("семнадцат", 17), ("восемнадцат", 18), ("девятнадцат", 19), ("двадцат", 20), ("тридцат", 30), ("сорок", 40),
    ("пятидесят", 50), ("пятьдесят", 50), ("девяност", 90), ("десят", 10), ("перв", 1), ("одн", 1), ("один", 1), ("втор", 2),
    ("два", 2), ("две", 2), ("двух", 2), ("трет", 3), ("три", 3), ("четвер", 4), ("четыр", 4), ("пят", 5), ("шест", 6),
    ("седьм", 7), ("сем", 7), ("восьм", 8), ("восем", 8), ("девят", 9),
)


def word_number(word: Column) -> Column:
    """The number that a word (lower case, е for ё) stands for, 1000 for thousands, null for other words."""
    return F.coalesce(F.when(word.startswith("тысяч"), 1000), *(F.when(word.startswith(stem), n) for stem, n in NUMBER_STEMS))


def _numbers(c: Column) -> Column:
    return F.array_compact(F.transform(F.regexp_extract_all(c, F.lit("[а-я]+"), 0), word_number))


@bound(1)
def parse_date_words(c: ColumnOrName) -> Column:
    """A date whose day and year may be words ('седьмое августа две тысячи двадцать шестого'); else as parse_date()."""
    low = F.translate(F.lower(text(c)), "ё", "е")
    month_pattern = "(?U)\\b(" + "|".join(f"{s}[а-я]*" if "[" not in s else "мая" for s in MONTH_STEMS) + ")\\b"
    own = let(low, lambda v: F.struct(v.alias("low"), F.regexp_extract(v, month_pattern, 1).alias("month"), F.regexp_instr(v, F.lit(month_pattern)).alias("at")))
    return F.coalesce(parse_date(c), let(own, lambda x: F.when(x["month"] != "", _around(x))))


def _around(x: Column) -> Column:
    """The date around a month's word: struct(low: the text, month, at)."""
    before, after = F.substring(x["low"], F.lit(1), x["at"] - 1), F.substring(x["low"], x["at"] + F.length(x["month"]), F.length(x["low"]))
    return let(F.struct(before.alias("before"), after.alias("after"), _month(x["month"]).alias("month"), _numbers(before).alias("words"), _sums(after).alias("sums")), _made)


def _sums(after: Column) -> Column:
    return F.aggregate(
        _numbers(after),
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("open")),
        lambda s, n: F.when(n == 1000, F.struct((s["total"] + F.greatest(s["open"], F.lit(1)) * 1000).alias("total"), F.lit(0).alias("open"))).otherwise(F.struct(s["total"].alias("total"), (s["open"] + n).alias("open"))),
    )


def _made(x: Column) -> Column:
    before, after, words, sums = x["before"], x["after"], x["words"], x["sums"]
    last = F.when(F.size(words) > 0, F.element_at(words, -1))
    last_two = F.when(F.size(words) > 1, F.element_at(words, -2))
    day = F.coalesce(_int(F.nullif(F.regexp_extract(before, r"(\d{1,2})\D*$", 1), F.lit(""))), F.when((last_two >= 20) & (last < 10), last_two + last).otherwise(last))
    spoken = F.when(sums["total"] > 0, sums["total"] + sums["open"])
    short = _int(F.nullif(F.regexp_extract(after, r"20\s*(\d{2})", 1), F.lit(""))) + 2000
    year = F.coalesce(_int(F.nullif(F.regexp_extract(after, r"(\d{4})", 1), F.lit(""))), short, spoken)
    return make_date(year, x["month"], day)
