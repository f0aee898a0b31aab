"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import pytest

from hearthline.plans.queries import ORACLE_SQL, QUERIES

from . import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_rows(spark, con, name):
    assert oracle.difference(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE_SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
