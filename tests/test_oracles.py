"""Every registered query against its DuckDB twin on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from panelspark import catalog

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = catalog.queries(), catalog.oracle_sql()
SLOW = {"perm_importance", "model_purged_cv", "gbt_rank", "rank_ndcg", "asof_scores", "shap_details", "shap_summary"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return float(v) if hasattr(v, "to_eng_string") else v


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(TWINS[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    mine = sorted((tuple(value(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(value(r[cols.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS) - SLOW))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.queries()) >= set(QUERIES) and set(e.oracle_sql()) >= set(TWINS)
