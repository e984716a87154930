import pytest
from oracle import same, there

from tessera.llm import queries

pytestmark = pytest.mark.skipif(not there(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name])
