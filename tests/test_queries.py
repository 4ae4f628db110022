import os

import pytest

from geochunk.plans.oracle import SQL
from geochunk.plans.queries import QUERIES
from tests.oracle import SF, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert not differences(spark, QUERIES[name], SQL[name])
