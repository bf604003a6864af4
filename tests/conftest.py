from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from assertloom.session import build_session

    s = build_session("tests", f"local[{os.environ.get('TEST_CPUS', '4')}]", spark_sql_shuffle_partitions="4", spark_default_parallelism="4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(v) -> str:
    """A value as text that Spark and DuckDB share."""
    if isinstance(v, float):
        return f"{v:.5g}"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def agree(spark, sf, duck):
    """Asserts that a query and its SQL give the same columns and rows."""

    def run(query, sql: str) -> None:
        df, rel = query(spark, sf), duck.sql(sql)
        columns = sorted(rel.columns)
        assert sorted(df.columns) == columns
        got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
        want = sorted(tuple(plain(dict(zip(rel.columns, r))[c]) for c in columns) for r in rel.fetchall())
        assert got == want

    return run
