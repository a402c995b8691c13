"""Verdict rules: configuration compiled to Column expressions over an array of checks and an array of flags.

A rule is {"when": {...}, "reason": text} with any of the conditions flag, check (with status, by default fail), any_status
and missing, all of which must hold. Rejecting rules come first: if any holds, the case is rejected for all their distinct
reasons in order; else the same for review; else the case is accepted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCEPT, REJECT, REVIEW = "accept", "reject", "review"
CHECK = "struct<name:string,status:string,application:string,passport:string,detail:string,crop:string>"


def _list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def condition(when: Mapping, checks: Column, flags: Column) -> Column:
    parts = []
    if "flag" in when:
        parts.append(F.array_contains(flags, when["flag"]))
    if "check" in when:
        statuses = _list(when.get("status", ["fail"]))
        parts.append(F.exists(checks, lambda c: (c["name"] == when["check"]) & c["status"].isin(*statuses)))
    if "any_status" in when:
        parts.append(F.exists(checks, lambda c: c["status"].isin(*_list(when["any_status"]))))
    if "missing" in when:
        parts.append(~F.exists(checks, lambda c: c["name"] == when["missing"]))
    if not parts:
        raise ValueError(f"a rule without a condition: {dict(when)}")
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def reasons(rules: Sequence[Mapping], checks: Column, flags: Column) -> Column:
    """Distinct reasons of the rules that hold, in their order."""
    if not rules:
        return F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.array(*(F.when(condition(r["when"], checks, flags), r["reason"]) for r in rules))))


def decide(rules: Mapping[str, Sequence[Mapping]], checks: Column, flags: Column) -> Column:
    """struct(code, reasons)."""
    reject, review = (reasons(rules.get(k) or [], checks, flags) for k in (REJECT, REVIEW))
    none = F.array().cast("array<string>")
    return (
        F.when(F.size(reject) > 0, F.struct(F.lit(REJECT).alias("code"), reject.alias("reasons")))
        .when(F.size(review) > 0, F.struct(F.lit(REVIEW).alias("code"), review.alias("reasons")))
        .otherwise(F.struct(F.lit(ACCEPT).alias("code"), none.alias("reasons")))
    )


def check(name: str, status: Column | str, application: Column | None = None, passport: Column | None = None, detail: Column | None = None, crop: Column | None = None) -> Column:
    """One check as a struct; texts that are not given are empty."""
    blank = F.lit("")
    value = lambda c: F.coalesce(c.cast("string"), blank) if c is not None else blank
    s = F.lit(status) if isinstance(status, str) else status
    crop = crop.cast("string") if crop is not None else F.lit(None).cast("string")
    return F.struct(F.lit(name).alias("name"), s.alias("status"), value(application).alias("application"), value(passport).alias("passport"), value(detail).alias("detail"), crop.alias("crop"))


def gather(*checks: Column) -> Column:
    """Checks, null where one does not apply, as an array in order."""
    return F.array_compact(F.array(*checks))


def confirm(checks: Column, rows_of: Mapping[str, Sequence[str]], confirmed: Column) -> Column:
    """Checks with those of confirmed rows turned from review or warn to ok."""
    rows = F.create_map(*(x for name, rows in rows_of.items() for x in (F.lit(name), F.array(*map(F.lit, rows))))) if rows_of else None

    def one(c: Column) -> Column:
        if rows is None:
            return c
        mine = F.coalesce(F.arrays_overlap(rows[c["name"]], confirmed), F.lit(False)) & c["status"].isin("review", "warn")
        done = c.withField("status", F.lit("ok")).withField("detail", F.concat(c["detail"], F.lit(" (confirmed)")))
        return F.when(mine, done).otherwise(c)

    return F.transform(checks, one)
