"""Summaries over a list: severity, order of problems, groups that should agree, found and missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Statuses from the worst to the best; no status is the least of all.
SEVERITY = (("fail", 4), ("review", 3), ("warn", 2), ("info", 1), ("ok", 0), ("", -1))
#: Problem groups of a domain list, the worst first.
PROBLEMS = ("free", "mismatch", "not_found", "error", "review", "warn", "info", "unchecked", "ok")
#: The problem group that a verdict stands for.
PROBLEM_OF = (("fail", "mismatch"), ("review", "review"), ("warn", "warn"), ("info", "info"), ("ok", "ok"))


def _lookup(pairs, c: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))[c]


def severity(status: Column) -> Column:
    return _lookup(SEVERITY, status)


def worst(statuses: Column) -> Column:
    """The most severe of an array of statuses; '' of none."""
    ranked = F.array_max(F.transform(statuses, lambda s: F.struct(severity(s).alias("rank"), s.alias("status"))))
    return F.coalesce(ranked["status"], F.lit(""))


def worst_of(status: str) -> Column:
    """The same as an aggregate."""
    return F.coalesce(F.max(F.struct(severity(F.col(status)).alias("rank"), F.col(status).alias("status")))["status"], F.lit(""))


def problem(lookup: Column, registry: Column, verdict: Column) -> Column:
    """The problem group of a name: by how its lookup ended, what the public registry says of it, and its verdict."""
    absent = F.when(registry == "free", "free").otherwise("not_found")
    return F.when(lookup == "not_found", absent).when(F.coalesce(lookup, F.lit("")) != "found", "error").otherwise(F.coalesce(_lookup(PROBLEM_OF, verdict), F.lit("unchecked")))


def problem_rank(code: Column) -> Column:
    return F.coalesce(_lookup([(p, i) for i, p in enumerate(PROBLEMS)], code), F.lit(len(PROBLEMS)))


def in_problem_order(rows: DataFrame, code: str, position: str) -> DataFrame:
    """The worst first, in the list's order within a group."""
    return rows.orderBy(problem_rank(F.col(code)), position)


def placed(rows: DataFrame, code: str, key: str, name: str = "place", width: int = 1_000_000) -> DataFrame:
    """Rows with their place from 1 in the problem order, by a number within a group. A row's place is the size of the ranges of
    numbers before its own, a table of a row for each range, and its rank in its range: no task gets more than a range."""
    parts = ["__rank", "__range"]
    ranged = rows.withColumn("__rank", problem_rank(F.col(code))).withColumn("__range", F.floor(F.col(key) / width))
    sizes = ranged.groupBy(*parts).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select(*parts, F.coalesce(F.sum("__n").over(W.orderBy(*parts).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy(*parts).orderBy(key))
    return ranged.withColumn("__inside", inside).join(before, parts).withColumn(name, F.col("__before") + F.col("__inside")).drop(*parts, "__before", "__inside")


def several_values(rows: DataFrame, keys: list[str], value: Column, name: str = "values") -> DataFrame:
    """Keys with more than one distinct value, and how many."""
    return rows.groupBy(*keys).agg(F.countDistinct(value).alias(name)).where(F.col(name) > 1)


def rare_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value and n of the values that are rarer than their key's most frequent one."""
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    most = counted.groupBy(*keys).agg(F.max("n").alias("most"))
    return counted.join(most, keys).where("n < most")


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """value and n, the most frequent first, then by value."""
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value)


def found_summary(rows: DataFrame, keys: list[str], status: str) -> DataFrame:
    """keys, found, missing, errors and result: anything missing is a fail, else any error needs review."""
    n = rows.groupBy(*keys).agg(*(F.count_if(F.col(status) == s).alias(a) for s, a in (("found", "found"), ("not_found", "missing"), ("error", "errors"))))
    return n.withColumn("result", F.when(F.col("missing") > 0, "fail").when(F.col("errors") > 0, "review").otherwise("ok"))


def fullest_group(rows: DataFrame, keys: list[str], group: str, value: str, known: Column) -> DataFrame:
    """For each key the group with most values that are present, known groups first, then the smaller name."""
    counted = rows.groupBy(*keys, group).agg(F.count_if(F.length(F.coalesce(F.col(value), F.lit(""))) > 0).alias("n")).withColumn("__known", known)
    best = counted.groupBy(*keys).agg(F.min(F.struct((~F.col("__known")).alias("k"), (-F.col("n")).alias("m"), F.col(group).alias("g"))).alias("b"))
    return best.select(*keys, F.col("b.g").alias(group), (-F.col("b.m")).alias("n"))
