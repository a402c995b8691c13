"""Matching rows of two tables: missing, known before, attribute by attribute, nearest, and what differs between two runs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseframe.functions.fields import same
from caseframe.operators.likeness import pairs_within_edits


def missing_items(items: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Items, repeats included, whose keys the other table does not have."""
    return items.join(known.select(*keys).distinct(), keys, "left_anti")


def first_match(rows: DataFrame, known: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Rows with the first value that the other table has for their keys, null without one."""
    first = known.groupBy(*keys).agg(F.min(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("__f"))
    return rows.join(first.select(*keys, F.col("__f.v").alias(name)), keys, "left")


def compare_attributes(rows: DataFrame, attributes: Mapping[str, tuple[str, str, str]], name: str = "compared") -> DataFrame:
    """An array of struct(field, status, score) for attributes {field: (left column, right column, kind)}: a projection."""
    out = [F.struct(F.lit(f).alias("field"), r["status"].alias("status"), r["score"].alias("score")) for f, (a, b, kind) in attributes.items() for r in (same(kind, a, b),)]
    return rows.withColumn(name, F.array(*out))


def counted_agreement(compared: Column) -> Column:
    """struct(ok, total) of compared attributes; those with nothing to compare don't count."""
    some = F.filter(compared, lambda x: x["status"] != "")
    return F.struct(F.size(F.filter(some, lambda x: x["status"] == "ok")).alias("ok"), F.size(some).alias("total"))


def nearest_by_edits(left: DataFrame, right: DataFrame, within: list[str], a: str, b: str, most: int, name: str = "nearest") -> DataFrame:
    """Left rows with the other table's nearest string at an edit distance of at most `most`, not their own, first in order of
    distance and then of string."""
    near = pairs_within_edits(left, right.withColumnRenamed(b, "__b"), within, a, "__b", most)
    best = near.groupBy(*within, a).agg(F.min(F.struct("edits", "__b")).alias("__best"))
    return best.select(*within, a, F.col("__best.__b").alias(name), F.col("__best.edits").alias("edits"))


def difference(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, before and after where two runs differ, rows that only one has included. Keys are unique in each."""
    a, b = before.select(*keys, F.col(value).alias("before")), after.select(*keys, F.col(value).alias("after"))
    return a.join(b, keys, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def pick_active(services: DataFrame, keys: list[str], service: str, active: Column, name: str = "picked") -> DataFrame:
    """keys, state and picked: of the distinct services of a key the only active one; without an active one the only one; else
    none, as 'ambiguous'."""
    one = services.groupBy(*keys, service).agg(F.max(active).alias("__a"))
    count = one.groupBy(*keys).agg(F.count_if("__a").alias("__n"), F.count(F.lit(1)).alias("__all"), F.min(F.when(F.col("__a"), F.col(service))).alias("__active"), F.min(service).alias("__any"))
    state = F.when(F.col("__n") == 1, "active").when((F.col("__n") == 0) & (F.col("__all") == 1), "inactive").otherwise("ambiguous")
    picked = F.when(F.col("__n") == 1, F.col("__active")).when((F.col("__n") == 0) & (F.col("__all") == 1), F.col("__any"))
    return count.select(*keys, state.alias("state"), picked.alias(name))
