"""Every registered query against its independent SQL, row by row."""

import math
from collections import Counter

import pytest

import __spark_entry__ as spark_entry
from accountlens.registry import oracle, queries

QUERIES, ORACLES = queries.queries(), oracle.oracle_sql()


def _plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def _kind(name: str) -> str:
    return {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
        "date": "DATE", "timestamp_ntz": "TIMESTAMP",
    }.get(name, name)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir)
    expected = duck.execute(ORACLES[name])
    columns = [d[0] for d in expected.description]
    assert sorted(got.columns) == sorted(columns)
    types = {d[0]: str(d[1]) for d in expected.description}
    assert {f.name: _kind(f.dataType.simpleString()) for f in got.schema} == types
    want = _bag(columns, expected.fetchall())
    rows = _bag(got.columns, [tuple(r) for r in got.collect()])
    assert rows == want, f"{sum((rows - want).values())} extra, {sum((want - rows).values())} missing"
    assert rows


def test_every_query_is_registered():
    assert set(QUERIES) <= set(spark_entry.queries()) and set(ORACLES) <= set(spark_entry.oracle_sql())


def test_entry(spark):
    result = spark_entry.entry(spark)
    assert result.count() == 25
    assert result.columns[0] == "company"
