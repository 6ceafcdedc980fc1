"""Every registered query against its SQL, at the smallest scale."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, rows_of
from helpers import plan_of
from registry.catalogue import all_queries

SMALL = "/root/testdata/sf0.001"
NEEDS_PYTHON = {"extract_archives", "archive_manifest", "archive_summary", "verify_member_crc"}
OWN = all_queries()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_equals_sql(spark, con, name):
    df = OWN[name].run(spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    result = con.execute(OWN[name].sql)
    assert rows_of(df.columns, rows) == rows_of([c[0] for c in result.description], result.fetchall())
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name not in NEEDS_PYTHON:
        assert "InPandas" not in plan and "Python" not in plan


def test_all_are_registered():
    assert set(OWN) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_tasks_need_no_copy_of_the_package(tmp_path):
    """The same query when the Python workers cannot import this repository."""
    root = os.path.dirname(os.path.abspath(entry_module.__file__))
    script = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "import __spark_entry__ as e\n"
        "from voltrail.session import build_session\n"
        "spark = build_session('elsewhere', 'local[2]', **{'spark.sql.shuffle.partitions': '2'})\n"
        f"print('rows', e.queries()['verify_member_crc'](spark, {SMALL!r}).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200" in done.stdout, done.stderr[-2000:]
