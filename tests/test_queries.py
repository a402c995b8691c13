"""Registered queries against their SQL, and the promises of the entry module."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__
from oracle import TESTDATA, differences

import caseframe.planted  # noqa: F401  registers its queries
import caseframe.planted_cases  # noqa: F401  registers its queries
import caseframe.scans  # noqa: F401  registers its queries
from caseframe.queries import ORACLE_SQL, QUERIES

SF = f"{TESTDATA}/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), SF, ORACLE_SQL[name]) == []


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["code", "worst", "n"]


def test_names_of_sql_are_names_of_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_everything_else_imports_without_the_training_data_operators():
    code = (
        "import sys; sys.modules['caseframe.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e\n"
        "assert not [n for n in e.queries() if n.startswith('op1') or n == 'pipeline']; assert len(e.queries()) > 30"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=HERE, env=os.environ | {"PYTHONPATH": HERE})
