import pytest
from oracle import compare

from ndspark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    compare(spark, sf, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["d0", "value"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
