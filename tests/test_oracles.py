"""Every query with SQL gives DuckDB's result on the smallest tables, where these are present."""

import glob
import math
import os
import re

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(norm, v)) if isinstance(v, list) else round(float(v), 6) if hasattr(v, "as_tuple") else v


def test_queries_match_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    queries, wrong = entry.queries(), []
    for name, sql in entry.oracle_sql().items():
        a = queries[name](spark, SF).toArrow()
        con.execute(sql)
        cols = [x[0] for x in con.description]
        want = sorted((tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in con.fetchall()), key=repr)
        got = sorted((tuple(norm(r[c]) for c in sorted(cols)) for r in a.to_pylist()), key=repr) if sorted(cols) == sorted(a.schema.names) else None
        if got != want:
            wrong.append(name)
    assert wrong == []


def test_queries_without_sql_run(spark):
    import __spark_entry__ as entry

    sql = entry.oracle_sql()
    for name, q in entry.queries().items():
        if name not in sql and not re.match(r"p\d+_", name):
            q(spark, SF).collect()
    assert entry.entry(spark).count() > 0
