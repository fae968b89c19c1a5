"""Every query with SQL gives DuckDB's rows on the same tables."""

import glob
import os

import duckdb
import pytest

from spritelake.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rounded(row):
    return tuple(round(v, 7) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(got.columns) == columns
    rows = sorted((rounded(r[c] for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((rounded(r[i] for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_packed_operators_do_not_shuffle(spark):
    for name in ("fringe_pixels", "pose_guide_edges", "alpha_boxes", "enclosed_holes", "row_longest_run"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name
