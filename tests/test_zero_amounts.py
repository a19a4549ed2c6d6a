"""Queries against their SQL on events of which many have the value 0, as larger tables do."""

import duckdb
import pytest
from conftest import SF, same_rows

from tidemark.plans import chain, logs  # noqa: F401
from tidemark.plans import queries as Q


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("zeros"))
    c = duckdb.connect()
    c.sql(f"copy (select * replace (case when event_id % 3 = 0 then 0.0 else value end as value) from '{SF}/events.parquet') to '{d}/events.parquet'")
    c.sql(f"create view events as select * from '{d}/events.parquet'")
    return d, c


@pytest.mark.parametrize("name", ["vault_changes", "manager_changes", "normalize_liquidity"])
def test_same_rows(spark, zeros, name):
    d, duck = zeros
    same_rows(Q.QUERIES[name](spark, d), duck, Q.SQL[name])
