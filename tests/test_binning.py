import pytest
from pyspark.sql import functions as F

from retailspark.functions import RF_SEGMENTS, RFM_CLASSES, cut, rf_segment, rfm_class

LEVELS = ["LOW", "MEDIUM", "HIGH"]


def labels(spark, values, breaks, **options):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double").coalesce(1)
    return [r["g"] for r in cut(df, "x", breaks, LEVELS, out="g", **options).orderBy("i").collect()]


def test_right_closed(spark):
    got = labels(spark, [0, 1, 1.5, 2, 2.5, 3, 3.5, 4, 5], [1, 2, 3, 4])
    assert got == [None, "LOW", "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", None]
    assert labels(spark, [1, 4], [1, 2, 3, 4], include_lowest=False) == [None, "HIGH"]


def test_left_closed(spark):
    got = labels(spark, [0, 1, 1.5, 2, 2.5, 3, 3.5, 4, 5], [1, 2, 3, 4], right=False)
    assert got == [None, "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "HIGH", None]
    assert labels(spark, [1, 4], [1, 2, 3, 4], right=False, include_lowest=False) == ["LOW", None]


@pytest.mark.parametrize(
    "breaks, right, values, want",
    [
        ([1, 1, 1, 5], False, [1, 3, 5], ["HIGH", "HIGH", "HIGH"]),
        ([1, 1, 1, 5], True, [1, 3, 5], ["HIGH", "HIGH", "HIGH"]),
        ([1, 2, 2, 8], False, [1, 2, 8], ["LOW", "HIGH", "HIGH"]),
        ([1, 2, 2, 8], True, [1, 2, 8], ["LOW", "LOW", "HIGH"]),
        ([1, 5, 5, 5], False, [1, 5], ["LOW", "HIGH"]),
        ([3, 3, 3, 3], True, [3], ["HIGH"]),
        ([3, 3, 3, 3], False, [3], ["HIGH"]),
    ],
)
def test_equal_breaks_collapse(spark, breaks, right, values, want):
    assert labels(spark, values, breaks, right=right, on_degenerate="collapse") == want


def test_equal_breaks_raise(spark):
    with pytest.raises(ValueError):
        labels(spark, [1], [1, 1, 2, 3])
    column = F.array(*[F.lit(b) for b in (1.0, 1.0, 2.0, 3.0)])
    with pytest.raises(Exception, match="not strictly increasing"):
        labels(spark, [1], column)


def test_breaks_from_a_subquery(spark):
    table = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "b array<double>")
    assert labels(spark, [1, 2, 2.5, 4], table.scalar()) == ["LOW", "LOW", "MEDIUM", "HIGH"]


def test_all_rf_cells(spark):
    df = spark.createDataFrame([(r, f) for r in LEVELS for f in LEVELS], "r string, f string")
    got = {(x.r, x.f): x.rf for x in df.select("r", "f", rf_segment("r", "f").alias("rf")).collect()}
    assert got == {
        ("LOW", "LOW"): "One-Timer",
        ("LOW", "MEDIUM"): "Engaged",
        ("LOW", "HIGH"): "Top",
        ("MEDIUM", "LOW"): "One-Timer",
        ("MEDIUM", "MEDIUM"): "Engaged",
        ("MEDIUM", "HIGH"): "Top",
        ("HIGH", "LOW"): "Leaving",
        ("HIGH", "MEDIUM"): "Leaving",
        ("HIGH", "HIGH"): "Leaving Top",
    }


def test_all_rfm_cells(spark):
    segments = ["One-Timer", "Leaving", "Engaged", "Leaving Top", "Top"]
    df = spark.createDataFrame([(s, m) for s in segments for m in LEVELS], "s string, m string")
    got = {(x.s, x.m): x.c for x in df.select("s", "m", rfm_class("s", "m").alias("c")).collect()}
    ladder = ["Cheap", "Tin", "Copper", "Bronze", "Silver", "Gold", "Diamond"]
    want = {(s, m): ladder[i + j] for i, s in enumerate(segments) for j, m in enumerate(LEVELS)}
    assert got == want and len(RFM_CLASSES) == 15 and len(RF_SEGMENTS) == 9


def test_no_breaks_give_no_label(spark):
    table = spark.createDataFrame([(None,)], "b array<double>")
    assert labels(spark, [1.0], table.scalar()) == [None]
