"""Every registered query runs on the smallest tables; those with SQL agree with it there."""

import math
import os

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def norm(v):
    return ("nan" if math.isnan(v) else repr(round(v, 6) + 0.0)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert registry.oracle_sql().keys() <= registry.queries().keys()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    want = sorted(tuple(norm(r[columns.index(c)]) for c in names) for r in cursor.fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns and df.count() > 0


def test_no_query_and_no_sql_is_left_out():
    """Modules that register by prefix must not lose a query or its SQL silently."""
    import inspect
    from importlib import import_module

    helpers = {"equity", "signals", "features", "validated", "provider_rows", "versions", "p_values", "observations", "indicators_all", "reg_transitions", "schedules", "rates", "runs"}
    registered = set(registry.oracle_sql().values())
    for name in registry.MODULES:
        module = import_module(f"tidemark.plans.{name}")
        public = {k for k, f in vars(module).items() if inspect.isfunction(f) and f.__module__ == module.__name__ and not k.startswith("_") and [*inspect.signature(f).parameters][:2] == ["spark", "sf_dir"]}
        assert public - helpers <= module.QUERIES.keys(), name
        texts = {k for k, v in vars(module).items() if k.endswith("_SQL") and isinstance(v, str) and v not in registered}
        assert not texts, f"{name}: {texts} are no query's SQL"
