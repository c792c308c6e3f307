import pytest

from docquery.plans import judging, registry, upkeep  # noqa: F401 - they register their queries
from tests.duck import compare


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, registry.QUERIES[name], registry.ORACLE_SQL[name])
