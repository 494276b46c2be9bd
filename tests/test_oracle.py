"""Every registered exact query equals its SQL (DuckDB) on the sf0.001 tables."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from chatmod.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
EXACT = sorted(k for k in E.oracle_sql() if k in QUERIES)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return c


def test_every_query_is_registered_with_sql_or_rows_only():
    from chatmod.plans.catalog import ROWS_ONLY
    assert set(QUERIES) == {k for k in E.oracle_sql() if k in QUERIES} | ROWS_ONLY
    assert set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", EXACT)
def test_query_matches_sql(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _canon(df.columns, rows) == _canon(ocols, orows)


_DUCK = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
         "BooleanType": "BOOLEAN", "TimestampNTZType": "TIMESTAMP"}


@pytest.mark.parametrize("name", EXACT)
def test_query_types_match_sql(spark, con, name):
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    duck = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    spark_types = {f.name: _DUCK.get(type(f.dataType).__name__, type(f.dataType).__name__) for f in df.schema.fields}
    assert spark_types == duck


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "toxic_ratio" in df.columns


# Queries allowed to run work while being built, and why (all bounded):
EAGER_ON_BUILD = {
    "skip_processed_batches": "size check of the ledger before broadcasting it (limit n + 1)",
    "leaderboard_changes": "per-batch deltas written once with checkpoint(eager=True)",
}


def test_building_a_query_runs_no_job(spark):
    """Building a query must not execute it (e.g. by asking a shuffled frame for its
    partition count); only the bounded, documented exceptions above may."""
    sc = spark.sparkContext
    for name, build in QUERIES.items():
        group = f"build-{name}"
        sc.setJobGroup(group, group)
        try:
            build(spark, SF)
        finally:
            sc.setJobGroup("", "")
        if name in EAGER_ON_BUILD:
            continue
        work = [j for j in sc.statusTracker().getJobIdsForGroup(group) if not _schema_job(sc, j)]
        assert work == [], f"{name} ran {len(work)} job(s) while being built"


def _schema_job(sc, job_id):
    """Reading a Parquet table starts a small footer job for schema inference
    (its stages are named after the ``parquet`` call): metadata, not the query."""
    info = sc.statusTracker().getJobInfo(job_id)
    stages = [sc.statusTracker().getStageInfo(s) for s in info.stageIds]
    return all(st is not None and st.name.startswith("parquet at ") for st in stages)


def test_every_query_returns_rows_on_the_oracle_tables(spark):
    """An empty result would match its SQL trivially: every registered query has rows."""
    empty = [name for name, build in QUERIES.items()
             if build(spark, "/root/testdata/sf0.01").limit(1).count() == 0]
    assert empty == []
