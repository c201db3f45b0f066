"""Every query of the subpackage that has SQL against it on DuckDB."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from nilas.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        duck.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    got, rel = QUERIES[name](spark, SF), duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    mine = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [rel.columns.index(c) for c in columns]
    assert mine == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
