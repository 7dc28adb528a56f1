"""Driver contract: keys, names and schemas of the registered queries."""

import re

import __spark_entry__ as E
from obsspark.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.queries()) and set(QUERIES) <= set(E.oracle_sql())
    assert len(QUERIES) >= 40


def test_query_names_are_plain_identifiers():
    for name in QUERIES:
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name), name
        assert not re.match(r"op\d+_", name)


def test_output_columns_are_named_and_unique(spark):
    for name, q in QUERIES.items():
        if name.startswith("bundle_"):
            continue  # these write to the shared folder; covered by the oracle test
        cols = q(spark, SF).columns
        assert len(cols) == len(set(cols)), (name, cols)
        for c in cols:
            assert re.fullmatch(r"[a-z][a-z0-9_]*", c), (name, c)
