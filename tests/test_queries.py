"""Every query of the core runs on the smoke tables; those with SQL agree with it."""

import importlib

import pytest

from corpuscle import registry
from tests.compare import same

MODULES = [importlib.import_module(m) for m in registry.MODULES]
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
ORACLE = {n: s for m in MODULES for n, s in m.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE:
        same(df, ORACLE[name], sf)
    else:
        assert df.count() >= 0


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)
