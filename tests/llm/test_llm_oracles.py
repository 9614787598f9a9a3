"""The SQL versions of this folder's queries on the small tables."""

import glob
import os

import duckdb
import pytest
from llm_helpers import DATA

from panelspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/sf0.01/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df, cur = queries.queries()[name](spark, f"{DATA}/sf0.01"), con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: repr(r)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted(cur.fetchall(), key=key)
