"""The operators' queries against their SQL, on two scales and on odd rows."""

import duckdb
import pytest

from check import TABLES, rows_of
from samples import make_docs, odd_rows, texts
from voltrail.llm import licenses, line_dedup
from voltrail.llm.registered import QUERIES

SMALL = "/root/testdata/sf0.001"
WITH_SQL = sorted(n for n, q in QUERIES.items() if q.sql)


def compared(df, sql, con):
    result = con.execute(sql)
    rows = [tuple(r) for r in df.collect()]
    assert rows_of(df.columns, rows) == rows_of([c[0] for c in result.description], result.fetchall())


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    compared(QUERIES[name].run(spark, SMALL), QUERIES[name].sql, con)


@pytest.mark.parametrize("op,sql", [(line_dedup.line_digests, line_dedup.SQL), (licenses.scan_licenses, licenses.SQL)])
def test_odd_rows_equal_sql(spark, tmp_path, op, sql):
    shared = "this line stands in very many of the documents, as often as not"
    rows = odd_rows(100) + [(i, f"{t}\n  {shared.upper()} \t\n{t}") for i, t in enumerate(texts(12))]
    rows += [(50, "Released under the MIT License.\nWhat? Licensed under CC BY-NC 4.0. Yes!"), (51, "All rights reserved")]
    docs = make_docs(spark, rows)
    path = str(tmp_path / "documents.parquet")
    docs.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    compared(op(docs), sql, con)


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES if n.startswith("op")] == [f"op{i}" for i in range(1, 14)]
