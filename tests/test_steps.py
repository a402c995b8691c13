"""What queries do once only, or in many tasks: read off their plans over the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import caseframe.composed  # noqa: F401  registers its queries
import caseframe.planted  # noqa: F401  registers its queries
import caseframe.scans  # noqa: F401  registers its queries
from caseframe.functions import zone
from caseframe.plans import answers
from caseframe.queries import QUERIES
from oracle import TESTDATA


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def query_plan(spark, name: str) -> str:
    return plan_of(QUERIES[name](spark, f"{TESTDATA}/sf0.001"))


def test_pages_of_passports_are_not_broadcast(spark):
    """Tables with a row for each page grow with the input: the driver collects none of them."""
    assert "Broadcast" not in query_plan(spark, "passport_main_text")


def test_pages_of_scans_are_not_broadcast(spark):
    """Their files are small, their rows are not: a word each, a field each."""
    assert "Broadcast" not in query_plan(spark, "fields_of_scans")


def test_quotes_are_aligned_once(spark):
    assert "ArrowEvalPython" not in query_plan(spark, "answers_placed")  # they are a step before
    assert query_plan(spark, "model_answers").count("ArrowEvalPython") == 1


def test_pages_are_parsed_once(spark):
    assert "MapInPandas" not in query_plan(spark, "html_records")


@pytest.mark.parametrize("name", ["zones_of_customers", "regions_of_issuers"])
def test_small_files_are_dealt_to_all_cores(spark, name):
    assert "REPARTITION_BY_NUM" in query_plan(spark, name)


def test_days_of_zones():
    assert [zone._date(s, 2026) for s in ("900315", "260101", "270101", "000229", "010229", "991332", "9O0101", "")] == ["15.03.1990", "01.01.2026", "01.01.1927", "29.02.2000", None, None, None, None]


def test_lines_of_a_letter_stay_in_its_row(spark):
    given = spark.createDataFrame([(1, ["b.ru"]), (2, ["zz.ru"]), (3, ["a.ru", "d.ru"])], "k int, items array<string>")
    texts = ["список\na.ru\nb.ru\nc.ru\nи всё\ne.ru", "a.ru", "a.ru\nпрочее\nd.ru\ne.ru\nx@f.ru\ng.ru"]
    letters = spark.createDataFrame(list(enumerate(texts, 1)), "k int, text string")
    found = answers.place_domains(given, letters, ["k"])
    assert {r["k"]: (r["not_in_text"], r["left_out"]) for r in found.select("k", "not_in_text", F.col("left_out")).collect()} == {1: ([], ["a.ru", "c.ru"]), 2: (["zz.ru"], []), 3: ([], ["e.ru"])}
    plan = plan_of(found)
    assert "Window" not in plan and "Generate" not in plan
