import os

import duckdb
import pytest

from contrastkit.llm.oracle import ORACLE_SQL
from contrastkit.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        db.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    found = db.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})")
    assert sorted(map(tuple, frame.select(*columns).collect())) == sorted(found.fetchall())


def test_quality_verdicts_where_cutoffs_are_certified(spark, sf_dir):
    """The small table certifies no cutoff; the next larger one rejects hundreds of documents beyond the base rules."""
    larger = sf_dir.replace("sf0.01", "sf0.1")
    if not os.path.isdir(f"{larger}/documents.parquet") and not os.path.isfile(f"{larger}/documents.parquet") or larger == sf_dir:
        pytest.skip("no larger tables")
    db = duckdb.connect()
    for table in ("documents", "labels"):
        path = f"{larger}/{table}.parquet"
        db.sql(f"create view {table} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    frame = QUERIES["op9_quality_rules"](spark, larger)
    columns = sorted(frame.columns)
    wanted = db.sql(f"select {', '.join(columns)} from ({ORACLE_SQL['op9_quality_rules']})").fetchall()
    got = sorted(map(tuple, frame.select(*columns).collect()))
    assert got == sorted(wanted)
    rejected = frame.where("not kept and not base_failed").count()
    assert rejected > 100
