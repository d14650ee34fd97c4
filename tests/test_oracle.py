"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

import __spark_entry__
from contrastkit.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _key(row):
    return tuple((v is None, "" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v)) for v in row)


def _same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return db


#: Too many draws for DuckDB; test_operators holds the operators' own numbers of replicates against exact p values.
WITHOUT_SQL = {"rsm9_production_replicates"}


def test_all_other_queries_have_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, sf_dir, duck, name):
    frame = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted((tuple(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()), key=_key)
    assert got
    found = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    wanted = sorted(duck.sql(f"select {quoted} from ({catalog.ORACLE_SQL[name]})").fetchall(), key=_key)
    assert len(got) == len(wanted)
    for a, b in zip(got, wanted):
        assert all(_same(x, y) for x, y in zip(a, b)), (name, columns, a, b)


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.count() == 3 and "mean_diff" in frame.columns


def test_sql_has_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
