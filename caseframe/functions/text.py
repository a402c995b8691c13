"""Text, list and code normalisation as Column functions. An empty string counts as missing, as null does."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: ColumnOrName) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) with c computed once: inside, it is a variable, so that expressions that use it often stay small."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def bound(n: int):
    """Makes the first n arguments of a function of Columns variables, as let() does."""

    def wrap(f):
        @wraps(f)
        def call(*args, **options):
            own = F.struct(*(col(c).alias(f"a{i}") for i, c in enumerate(args[:n])))
            return let(own, lambda s: f(*(s[f"a{i}"] for i in range(n)), *args[n:], **options))

        return call

    return wrap


def present(c: ColumnOrName) -> Column:
    """Neither null nor empty."""
    return F.length(text(c)) > 0


def first_present(*cs: ColumnOrName) -> Column:
    """The first value that is present; null if none is."""
    return F.coalesce(*(F.nullif(text(c), F.lit("")) for c in cs))


def squeeze(c: ColumnOrName) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def fold(c: ColumnOrName) -> Column:
    """Upper case, Ё as Е, single blanks, no blanks, commas or full stops at the ends."""
    plain = F.regexp_replace(F.translate(F.upper(text(c)), "Ё", "Е"), r"(?U)\s+", " ")
    return F.btrim(plain, F.lit(" .,"))


def word_key(c: ColumnOrName) -> Column:
    """Lower case, ё as е, letters and digits only, words apart by one blank."""
    plain = F.translate(F.lower(text(c)), "ё", "е")
    return F.trim(F.regexp_replace(plain, "[^0-9a-zа-я]+", " "))


def digits(c: ColumnOrName) -> Column:
    return F.regexp_replace(text(c), "[^0-9]", "")


def phone_digits(c: ColumnOrName) -> Column:
    """Digits; a domestic prefix 8 or none before a mobile number becomes 7."""
    d = digits(c)
    return F.when((F.length(d) == 11) & d.startswith("8"), F.concat(F.lit("7"), F.substring(d, 2, 10))).when((F.length(d) == 10) & d.startswith("9"), F.concat(F.lit("7"), d)).otherwise(d)


#: Names of one country, and three-letter codes that do not begin with their two-letter code.
HOME_NAMES = ("РОССИЯ", "РФ", "РОССИЙСКАЯ ФЕДЕРАЦИЯ", "RUSSIA", "RUSSIAN FEDERATION")


def country_code(c: ColumnOrName, alpha3: dict[str, str]) -> Column:
    """Two-letter code of a country given by code or, for the home country, by name; unknown values in upper case."""
    v = F.translate(F.upper(squeeze(c)), "Ё", "Е")
    table = F.create_map(*(F.lit(x) for pair in alpha3.items() for x in pair)) if alpha3 else None
    known = F.coalesce(table[v], v) if table is not None else v
    return F.when(v.isin(*HOME_NAMES), "RU").otherwise(known)


def tokens(c: ColumnOrName, pattern: str) -> Column:
    """Parts between matches of a pattern, empty ones left out."""
    return F.filter(F.split(text(c), pattern), lambda x: x != "")


def split_emails(c: ColumnOrName) -> Column:
    """Addresses of a free-form list, lower-cased, without angle brackets, each once in the order of first sight."""
    clean = F.transform(tokens(c, r"(?U)[\s,;]+"), lambda x: F.lower(F.btrim(x, F.lit("<>"))))
    return F.array_distinct(F.filter(clean, lambda x: x.contains("@")))


def to_punycode(c: ColumnOrName) -> Column:
    """The ASCII form of a host name; names that have none stay as they are."""
    return F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), text(c)), text(c))


def to_unicode(c: ColumnOrName) -> Column:
    return F.when(text(c).contains("xn--"), F.coalesce(F.try_reflect(F.lit("java.net.IDN"), F.lit("toUnicode"), text(c)), text(c))).otherwise(text(c))


def split_hosts(c: ColumnOrName) -> Column:
    """Host names of a free-form list: scheme, path and last dot cut off, at least one dot inside, each once in order."""
    bare = F.transform(tokens(F.lower(text(c)), r"(?U)[\s,;]+"), lambda x: F.rtrim(F.split_part(F.regexp_replace(x, "^[a-z]+://", ""), F.lit("/"), F.lit(1)), F.lit(".")))
    return F.array_distinct(F.filter(bare, lambda x: x.contains(".") & (x != "")))


def host_of_url(c: ColumnOrName) -> Column:
    """Lower-cased host without a leading www."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(text(c), F.lit("HOST")), F.lit(""))), r"^www\.(?=.*\.)", "")


def ordered_distinct(c: ColumnOrName) -> Column:
    return F.array_distinct(col(c))


def union_in_order(*cs: ColumnOrName) -> Column:
    """Elements of several arrays, each once, in the order of first sight; null arrays count as empty."""
    return F.array_distinct(F.concat(*(F.coalesce(col(c), F.array().cast("array<string>")) for c in cs)))


def not_in(items: ColumnOrName, known: ColumnOrName) -> Column:
    """The items, repeats included, that the other array does not have in lower case."""
    low = F.transform(col(known), F.lower)
    return F.filter(col(items), lambda x: ~F.array_contains(low, x))
