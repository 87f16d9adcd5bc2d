"""Every registered query with SQL agrees with it, and the plans hold no cross join or Python step."""

import glob
import os

import pytest
from tables import SMALL

import __spark_entry__ as entry
from catalogue import params as P
from catalogue.oracle import ORACLE
from catalogue.queries import QUERIES, lines_of
from retailspark import columns as C
from retailspark.operators import filters as flt
from retailspark.operators import rules as rl
from retailspark.sources import star
from tools.check_oracle import canonical

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SMALL):
        pytest.skip("no test data")
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, cursor.fetchall())


def test_entry(spark, folder):
    assert entry.entry(spark).count() == 52


def plan(df):
    return df._jdf.queryExecution().toString()


#: Their results are rows made of a fitted model or a few numbers.
SMALL_RESULTS = [
    "tree_rules", "tree_importances", "tree_complexity", "logistic_coefficients", "logistic_summary",
    "logistic_null_deviance", "logistic_resampled", "basket_totals_with_gaps",
]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SMALL_RESULTS)))
def test_plans_have_no_cross_join_and_no_python(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "FlatMapGroups", "BatchEvalPython"):
        assert bad not in text


def test_window_reaches_the_scan(spark, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    lines = flt.in_window(star.tickets(spark, folder), C.MOMENT, P.LOOKBACK, P.REF, "neither").select(C.CUSTOMER)
    text = plan(lines)
    assert "GreaterThanOrEqual(o_orderdate,1999-01-02T00:00), LessThan(o_orderdate,2000-01-01T00:00)" in text
    assert "ReadSchema: struct<l_orderkey:bigint>" in text


def test_strict_thresholds_on_brands(spark, folder):
    lines = lines_of(spark, folder, "p_brand")
    assert rl.rules_of_lines(lines, min_support=0.001, min_confidence=0.8).count() == 866


def test_sql_belongs_to_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_baskets_are_counted_in_long_form(spark, folder):
    for name in ("basket_summary", "item_frequency"):
        assert "collect_set" not in plan(QUERIES[name](spark, folder))


def test_pruning_reads_its_rules_once(spark, folder):
    lines = lines_of(spark, folder, "p_brand")
    text = plan(rl.prune(rl.rules_of_lines(lines, min_support=0.01, min_confidence=0.1)))
    assert "lineitem" not in text and "orders" not in text
