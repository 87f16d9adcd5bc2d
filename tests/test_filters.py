import pytest
from pyspark.sql import functions as F
from tables import day, rows, tickets

from retailspark import columns as C
from retailspark.functions import days_between, parse_day
from retailspark.operators import filters as flt

DAYS = ["2018-10-01", "2018-10-02", "2018-12-31", "2019-01-01", "2019-01-02", "2019-02-28", "2019-03-01"]


@pytest.fixture(scope="module")
def lines(spark):
    return tickets(spark, [(f"c{i}", f"t{i}", "a", d, 1, 1, 0) for i, d in enumerate(DAYS)])


@pytest.mark.parametrize("col", [C.DAY, C.MOMENT])
@pytest.mark.parametrize(
    "lo, hi, closed, kept",
    [
        ("01/01/2019", None, "neither", ["2019-01-02", "2019-02-28", "2019-03-01"]),
        ("01/01/2019", "1/03/2019", "left", ["2019-01-01", "2019-01-02", "2019-02-28"]),
        ("01/10/2018", "1/1/2019", "neither", ["2018-10-02", "2018-12-31"]),
        ("2018-10-01", "2018-10-02", "both", ["2018-10-01", "2018-10-02"]),
        ("2018-10-01", "2018-10-02", "right", ["2018-10-02"]),
        (None, "2018-10-02", "left", ["2018-10-01"]),
    ],
)
def test_window_ends(lines, col, lo, hi, closed, kept):
    got = flt.in_window(lines, col, lo, hi, closed).select(F.col(C.DAY).cast("string"))
    assert [r[0] for r in rows(got)] == kept


def test_window_on_moments_covers_whole_days(spark):
    df = spark.sql("SELECT timestamp_ntz'2019-01-01 23:59:59' AS m UNION ALL SELECT timestamp_ntz'2019-01-02 00:00:00'")
    assert flt.in_window(df, "m", "2019-01-01", None, "neither").count() == 1
    assert flt.in_window(df, "m", None, "2019-01-01", "both").count() == 1


def test_unknown_closed_end(lines):
    with pytest.raises(ValueError):
        flt.in_window(lines, C.DAY, "2019-01-01", None, "open")


def test_latest_rows(lines):
    assert [r[C.DAY] for r in flt.latest_rows(lines).collect()] == [day("2019-03-01")]


def test_floor_is_strict_and_decimal(spark):
    df = spark.sql("SELECT cast(0.01 AS decimal(18,2)) AS MONETARY_VALUE UNION ALL SELECT 0.02 UNION ALL SELECT -5.00")
    assert [str(r[0]) for r in flt.min_value(df).collect()] == ["0.02"]


def test_project_and_complete_cases(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "y", 3.0)], "a int, b string, c double")
    out = flt.project(df, drop=["c"], copies={"d": "b"}, constants={"e": 0}, rename={"a": "id"}, casts={"a": "string"})
    assert out.columns == ["id", "b", "d", "e"] and rows(out)[0] == ("1", "x", "x", 0)
    assert rows(flt.complete_cases(df)) == [(2, "y", 3.0)]
    assert flt.complete_cases(df, ["a", "b"]).count() == 2


def test_dates(spark):
    df = spark.createDataFrame([("01/03/2019",), ("1/3/2019",), ("31/02/2019",), ("soon",), (None,)], "s string")
    got = [r[0] for r in df.select(parse_day(F.col("s"))).collect()]
    assert got == [day("2019-03-01"), day("2019-03-01"), None, None, None]
    gap = df.limit(1).select(days_between(F.lit(day("2019-04-30")), F.lit(day("2019-01-25"))))
    assert gap.first()[0] == 95
