"""Queries of this subpackage with SQL give DuckDB's rows on the smallest tables."""

import pytest

from hearthline.llm.queries import ORACLE_SQL, QUERIES

from . import helpers as H
from .. import oracle


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_rows(spark, name):
    assert oracle.difference(QUERIES[name](spark, H.SF), oracle.connect(H.SF), ORACLE_SQL[name]) == ""
