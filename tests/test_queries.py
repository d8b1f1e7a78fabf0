import compare
import pytest

from quillsift import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.oracle(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in registry.ORACLES:
        exp = con.sql(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(exp.columns)
        assert compare.rows(got) == compare.rows(exp)


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
