"""Check digits as folds over the digits of a string, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseframe.functions.text import ColumnOrName, bound, text

#: Weights of the tax number's control digits (10 digits; 12 digits, first and second).
TAX_10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
TAX_12_FIRST = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
TAX_12_SECOND = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def _digit(c: Column, i: int) -> Column:
    return F.substring(c, i + 1, 1).cast("int")


def _weighted(c: Column, weights: tuple[int, ...]) -> Column:
    total = _digit(c, 0) * weights[0]
    for i, w in enumerate(weights[1:], 1):
        total = total + _digit(c, i) * w
    return total % 11 % 10


@bound(1)
def tax_number_valid(c: ColumnOrName) -> Column:
    """Control digits of a number of 10 or 12 digits; anything else is not valid."""
    v = text(c)
    ten = F.regexp_extract(v, "^[0-9]{10}$", 0)
    twelve = F.regexp_extract(v, "^[0-9]{12}$", 0)
    return (
        F.when(ten != "", _weighted(ten, TAX_10) == _digit(ten, 9))
        .when(twelve != "", (_weighted(twelve, TAX_12_FIRST) == _digit(twelve, 10)) & (_weighted(twelve, TAX_12_SECOND) == _digit(twelve, 11)))
        .otherwise(False)
    )


def zone_check_digit(c: ColumnOrName) -> Column:
    """Check digit of a machine-readable zone field: weights 7, 3, 1 in turn; A-Z count 10 to 35, fillers 0."""
    letters = F.filter(F.split(F.upper(text(c)), ""), lambda x: x != "")
    code = F.transform(
        letters,
        lambda x, i: F.when(x.rlike("[0-9]"), F.ascii(x) - 48).when(x.rlike("[A-Z]"), F.ascii(x) - 55).otherwise(0) * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i % 3 + 1).cast("int")),
    )
    return F.aggregate(code, F.lit(0), lambda s, x: s + x) % 10


@bound(1)
def luhn_valid(c: ColumnOrName) -> Column:
    """Every second digit from the right counts double, nines cast out; the sum is a multiple of ten."""
    figures = F.filter(F.split(F.reverse(text(c)), ""), lambda x: x != "")
    value = F.transform(figures, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.when(text(c).rlike("^[0-9]+$"), F.aggregate(value, F.lit(0), lambda s, x: s + x) % 10 == 0).otherwise(False)


@bound(1)
def document_number(c: ColumnOrName) -> Column:
    """'SSSS NNNNNN' from the first number of two, two and six digits, which may stand apart; null without one."""
    pattern = r"(?U)(?<![\d+])(\d{2})\s?(\d{2})\s?[№N]?\s?(\d{6})(?!\d)"
    part = lambda g: F.regexp_extract(text(c), pattern, g)
    return F.when(part(3) != "", F.concat(part(1), part(2), F.lit(" "), part(3)))
