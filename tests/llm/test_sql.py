"""Registered queries against their SQL, names and types of columns included."""

import duckdb
import pytest

pytest.importorskip("colinear.llm.queries")
from colinear.llm.queries import oracle_sql, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "int": "INTEGER"}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries()[name](spark, SF), con.sql(oracle_sql()[name])
    assert sorted((c, TYPES[t]) for c, t in got.dtypes) == sorted(zip(want.columns, map(str, want.types), strict=True))
    columns = sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.select(", ".join(columns)).fetchall()))
