"""Every Spark query that has a DuckDB oracle, against it, at sf0.01."""
import pytest

import __spark_entry__ as E
from check_oracle import value_hash
from tessera.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sp = E.queries()[name](spark, SF).toPandas()
    dk = duck.execute(E.oracle_sql()[name]).df()
    assert len(sp) > 0, "an empty result proves nothing"
    assert sorted(sp.columns) == sorted(dk.columns)
    assert len(sp) == len(dk)
    assert value_hash(sp) == value_hash(dk)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle_has_rows(spark, name):
    assert E.queries()[name](spark, SF).limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["n"] > 0
