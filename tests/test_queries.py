"""Every registered query against the comparison engine."""

import pytest
from conftest import SF, same_rows

from tidemark.plans import chain, flows, logs, more, panels, tokens  # noqa: F401
from tidemark.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows(spark, duck, name):
    same_rows(Q.QUERIES[name](spark, SF), duck, Q.SQL[name])


def test_clusters_are_components(spark):
    edges = Q._edges(spark, SF).collect()
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for e in edges:
        a, b = root((e.token_address, e.a)), root((e.token_address, e.b))
        if a != b:
            parent[max(a, b)] = min(a, b)
    want = {x: root(x)[1] for x in parent}
    got = {(r.token_address, r.address): r.cluster for r in Q.QUERIES["wallet_clusters"](spark, SF).collect()}
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
