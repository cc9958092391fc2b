"""Registered queries with SQL against it, and what all of them have in common."""

from collections import Counter

import pytest

from accountlens.llm import queries as llm

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def test_all_operators_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in llm.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(name, spark, sf_dir, duck):
    got = llm.queries()[name](spark, sf_dir)
    expected = duck.execute(llm.oracle_sql()[name])
    types = {d[0]: str(d[1]) for d in expected.description}
    assert {f.name: KINDS[f.dataType.simpleString()] for f in got.schema} == types
    columns = [d[0] for d in expected.description]
    rows, want = Counter(tuple(r) for r in got.select(*columns).collect()), Counter(expected.fetchall())
    assert rows == want and rows
