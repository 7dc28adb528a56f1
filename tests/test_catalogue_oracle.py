"""Every catalogue query against its DuckDB oracle at sf0.001."""

import pytest

import __spark_entry__ as E
from obsspark.plans.catalogue import QUERIES
from tools.check_oracle import duck, rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    scols = df.columns
    srows = rows_of(scols, [tuple(r) for r in df.collect()])
    sql = E.oracle_sql().get(name)
    if sql is None:
        pytest.skip("no oracle")
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    assert sorted(scols) == sorted(ocols)
    assert srows == rows_of(ocols, res.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["service", "file", "seq", "ts", "line", "rank_ms"]


_TYPE_MAP = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_column_types_match_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    spark_types = {f.name: _TYPE_MAP.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    res = con.execute(E.oracle_sql()[name])
    duck_types = {d[0]: str(d[1]) for d in res.description}
    assert spark_types == duck_types
