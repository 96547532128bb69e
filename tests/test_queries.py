"""Every engine query against its SQL on the smallest tables."""

import pytest

from tessera import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(engine.queries()))
def test_query(spark, duck, canon, name):
    got = engine.queries()[name](spark, SF).toPandas()
    assert len(got)
    if sql := engine.oracle_sql().get(name):
        assert canon(got) == canon(duck(SF, sql))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
