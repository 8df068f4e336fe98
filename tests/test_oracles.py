from __future__ import annotations

import pytest

from quernstone.plans.queries import QUERIES, SQL
from tests.oracle import assert_same

TABLES = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, TABLES), SQL[name], TABLES)
