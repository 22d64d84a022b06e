"""Queries of the operators against their SQL."""

import pytest
from compare import database, difference

from rosterlens.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows(spark, name):
    count, wrong = difference(QUERIES[name](spark, FOLDER), database(FOLDER), SQL[name])
    assert wrong is None
    assert count > 0
