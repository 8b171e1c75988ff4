"""Every core query against its SQL on the smallest tables, and the contract of the entry module."""

import importlib

import pytest
from conftest import SMALL, same

import __spark_entry__ as entry

CORE = {k: f for m in map(importlib.import_module, entry.CORE) for k, f in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert CORE[name](spark, SMALL).count() > 0
    else:
        same(spark, duck, CORE[name], sql)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
