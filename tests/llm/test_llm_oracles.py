"""Queries with a SQL oracle give its rows on the small tables."""

import pytest

from quarry.llm.registry import QUERIES, SQL


def rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in recs), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, oracle, sf, name):
    got = QUERIES[name](spark, sf)
    want = oracle.execute(SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert rows(got.columns, map(tuple, got.collect())) == rows(cols, want.fetchall())


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
