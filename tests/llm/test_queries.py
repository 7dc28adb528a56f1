from __future__ import annotations

import re

import pytest

import __spark_entry__ as E
from obsspark.llm.queries import ORACLE, QUERIES
from tools.check_oracle import duck, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, name):
    got = QUERIES[name](spark, SF)
    want = duck(SF).execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


def test_all_operators_and_the_pipeline_are_registered():
    names = E.queries()
    assert {int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in names) if m} == set(range(1, 14))
    assert "pipeline" in names and set(ORACLE) <= set(E.oracle_sql())
