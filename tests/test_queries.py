"""The registry, and a selection of queries against their SQL twins on the smallest tables."""

import glob
import os
import subprocess
import sys

import datetime

import duckdb
import pytest

import __spark_entry__ as entry_points
from tidewater.queries.bindings import SCHEMAS

SF = "/root/testdata/sf0.001"
CHOSEN = ["haul_preparation", "cpue_by_day", "fleet_metrics", "effort_table", "catch_by_rect", "sampling_overview",
          "median_and_interval", "raised_length_totals", "process_error", "yearly_figures", "advice_table", "survey_files_parsed",
          "saved_runs_reloaded", "files_that_arrive_later", "long_report_by_lines", "texts_of_large_groups", "days_that_roll_up"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_twin_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_the_registry_needs_no_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry_points.__file__), timeout=120)


def test_entry_returns_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["fleet", "year", "cpue", "n"] and df.count() > 0


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_twin(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    cur = duck.execute(entry_points.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == sorted(cur.fetchall(), key=repr)


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    """A folder of small tables: trips with several species, rows that come twice, a line without a vessel."""
    folder = str(tmp_path_factory.mktemp("own"))
    day = datetime.datetime(1997, 3, 1)
    lines = [(i // 5, i % 9, i % 4, i % 3 + 1, float(i % 31 + 1), 900.0 + i, 0.0, 0.01 * (i % 3), "R", "F", day + datetime.timedelta(days=i * 11 % 900))
             for i in range(300)]
    tables = {"region": [(0, "EAST"), (1, "WEST")], "nation": [(0, "a", 0), (1, "b", 1)],
              "supplier": [(k, f"s{k}", k % 2, 0.0) for k in range(3)],
              "part": [(k, "p", "b", ("PROMO", "SMALL", "LARGE")[k % 3], 1, 1.0) for k in range(9)],
              "lineitem": [*lines, *lines[:20]]}
    for name, rows in tables.items():
        spark.createDataFrame(rows, SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    return folder


def of_own_rows(spark, own, name):
    """A query's plan, after its rows are compared with the twin's."""
    con = duckdb.connect()
    for f in glob.glob(f"{own}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}/*.parquet'")
    df = entry_points.queries()[name](spark, own)
    cur = con.execute(entry_points.oracle_sql()[name])
    got = sorted((tuple(r[d[0]] for d in cur.description) for r in df.collect()), key=repr)
    assert got and got == sorted(cur.fetchall(), key=repr)
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


@pytest.mark.parametrize("name", ["hauls_in_target_tripweeks_only", "hauls_of_target_tripweeks"])
def test_hauls_meet_their_tripweeks_in_tasks_of_bounded_size(spark, own, name):
    assert of_own_rows(spark, own, name).count("REPARTITION_BY_NUM") == 2


def test_two_level_totals_hold_no_row_per_day(spark, own):
    assert of_own_rows(spark, own, "two_level_totals").count("HashAggregate(") == 4  # both levels, before and after a shuffle
