import pytest

from lodestone import queries
from tests.compare import difference

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    assert difference(spark, FOLDER, queries.queries()[name], queries.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_gives_rows(spark, name):
    assert queries.queries()[name](spark, FOLDER).count() > 0
