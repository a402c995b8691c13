"""Steps whose work once grew with how often their results are used."""

from __future__ import annotations

import os
import random

import pytest
from oracle import TESTDATA
from pyspark.sql import functions as F

import caseframe.planted  # noqa: F401  registers its queries
import caseframe.planted_cases  # noqa: F401  registers its queries
from caseframe.functions import similarity
from caseframe.plans import checks
from caseframe.queries import QUERIES

SF = f"{TESTDATA}/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_common_subsequences_around_the_bits_of_a_long(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("абвАВё-z ") for _ in range(draw.choice([0, 1, 5, 9, 61, 62, 63, 70])))
    rows = [(word(), word()) for _ in range(200)] + [("a" * 62, "a" * 62 + "b"), ("ab" * 31, "ba" * 40)]
    found = spark.createDataFrame(rows, "a string, b string").select("a", "b", similarity.indel_ratio("a", "b").alias("r")).collect()
    assert all(abs(r.r - similarity._row_ratio(r.a, r.b)) < 1e-9 for r in found)


def test_a_check_compares_its_names_once(spark):
    made = checks.name_check("x", checks.Case(checks.Settings()), F.col("case_id"), F.col("app")["x"])
    plan = plan_of(spark.createDataFrame([], checks.CASE).select(made))
    assert 1 <= plan.count("ВИЧЕМ") <= 2  # the table of endings


@needs_data
@pytest.mark.parametrize("name", ["form_fields", "operator_edits"])
def test_fields_are_read_once(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert plan.count("ИНН") < 30


@needs_data
def test_rows_of_small_files_are_spread(spark):
    assert QUERIES["checks_of_issuers"](spark, SF).rdd.getNumPartitions() >= 16


def test_number_words_and_a_sections_lines_are_read_once(spark):
    from caseframe.functions import dates
    from caseframe.plans import forms

    one = spark.createDataFrame([], "x string")
    assert plan_of(one.select(dates.parse_date_words("x"))).count("одиннадцат") <= 4
    assert plan_of(one.select(forms.new_owner_section(F.col("x")))).count("ООО") <= 4


@needs_data
def test_cases_are_not_joined_with_themselves(spark):
    assert plan_of(QUERIES["export_of_cases"](spark, SF)).count("Join") == 1  # the kinds of cases
