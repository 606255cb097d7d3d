"""Registered queries against their SQL on the small tables."""

import os

import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(DIR):
    pytest.skip("no test tables", allow_module_level=True)

from emberline.plans import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def norm(rows):
    cell = lambda v: "NULL" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in rows)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    if name in ORACLE_SQL:
        want = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({ORACLE_SQL[name]})").fetchall()
        assert norm(rows) == norm(want)
