import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

import __spark_entry__ as entry
import compare

# One query of each area; tests/compare.py runs all of them.
SAMPLE = (
    "a03_ignore_filter", "b05_clean_summary", "c02_token_cost", "d06_choose_output", "e02_resolve_imports",
    "f23_validate_documents", "g10_blueprint_verdict", "h04_apply_baseline", "h20_duplicate_blocks",
)


@pytest.fixture(scope="module")
def con():
    return compare.connect("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", SAMPLE)
def test_agrees_with_sql(spark, con, sf_dir, name):
    assert compare.difference(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name]) is None


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.QUERIES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).collect()[0]["files_changed"] > 0
