import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from tables import rows, tickets

from retailspark import columns as C
from retailspark.operators import aggregates as agg
from retailspark.operators import filters as flt
from retailspark.operators import joins as jn
from retailspark.operators import windows as wd
from retailspark.plans import rfm as rf

LINES = [
    ("a", "t1", "x", "2019-01-10", 1, 10, 1),
    ("a", "t1", "y", "2019-01-10", 1, 5, 0),
    ("a", "t2", "x", "2019-04-20", 1, 7, 0.5),
    ("a", "t3", "x", "2019-04-25", -1, -10, 0),
    ("b", "t4", "z", "2019-04-30", 1, 3, 0),
    ("c", "t5", "z", "2019-02-01", -1, -4, 0),  # refunds only
    ("d", "t6", "x", "2019-03-01", 1, None, 0),  # missing amount
    ("d", "t7", "x", "2019-03-02", 1, 8, 0),
    ("e", "t8", "x", "2019-03-05", 1, 2, 0),  # refunds exceed purchases
    ("e", "t9", "x", "2019-03-06", -1, -9, 0),
    ("f", None, "x", "2019-03-07", 1, 2, 0),  # ticket without id
    ("g", "t10", "x", "2019-01-01", 1, 2, 0),  # on the excluded edge
]


@pytest.fixture(scope="module")
def lines(spark):
    return tickets(spark, LINES)


def test_recency_counts_purchases_only(lines):
    got = {r[C.CUSTOMER]: r[C.RECENCY] for r in agg.recency(lines, "30/04/2019").collect()}
    assert got == {"a": 10, "b": 0, "d": 59, "e": 56, "f": 54, "g": 119}


def test_frequency_counts_tickets(lines):
    got = {r[C.CUSTOMER]: r[C.VISITS] for r in agg.frequency(lines).collect()}
    assert got == {"a": 2, "b": 1, "d": 2, "e": 1, "f": 0, "g": 1}
    near = {r[C.CUSTOMER]: r[C.VISITS] for r in agg.frequency(lines, method="approx").collect()}
    assert near == got


def test_monetary_includes_refunds_and_passes_nulls_on(lines):
    got = {r[0]: r[1] for r in agg.monetary(lines).collect()}
    assert got["a"] == Decimal("10.5") and got["c"] == Decimal(-4) and got["e"] == Decimal(-7) and got["d"] is None
    lenient = {r[0]: r[1] for r in agg.monetary(lines, null_policy="ignore").collect()}
    assert lenient["d"] == Decimal(8)
    with pytest.raises(ValueError):
        agg.monetary(lines, null_policy="other")


def test_spend_excludes_refunds(lines):
    got = {r[C.CUSTOMER]: r for r in agg.spend(lines).collect()}
    assert "c" not in got
    assert (got["a"][C.GROSS], got["a"][C.DISCOUNT], got["a"][C.SPEND]) == (Decimal(22), Decimal("1.5"), Decimal("20.5"))


def test_fused_measures_equal_the_single_ones(lines):
    chosen = flt.in_window(lines, C.DAY, "2019-01-01", None, "neither")
    active = flt.active_only(agg.recency(chosen, "2019-04-30"))
    kept = jn.restrict_to(chosen, active)
    single = jn.assemble(C.CUSTOMER, active, agg.frequency(kept), agg.monetary(kept))
    fused = flt.active_only(rf.customer_measures(chosen, "2019-04-30"))
    assert rows(single.select(sorted(single.columns))) == rows(fused.select(sorted(fused.columns)))
    assert "g" not in [r[0] for r in fused.select(C.CUSTOMER).collect()]


def test_populations_of_the_breaks(spark):
    data = [(f"c{i}", f"t{i}-{k}", "x", f"2019-04-{1 + i:02d}", 1, 10 * (i + 1), 0) for i in range(20) for k in range(1 + i // 5)]
    data += [("poor", "tp", "x", "2019-04-30", 1, 0.01, 0)]
    groups = rf.rfm_groups(tickets(spark, data), "2019-01-01", "2019-04-30", on_degenerate="collapse")
    by = {r[C.CUSTOMER]: r for r in groups.collect()}
    assert by["poor"][C.MONETARY_GROUP] is None and by["poor"][C.RECENCY_GROUP] == "LOW"
    table = rf.rfm_segments(rf.with_value(groups))
    assert table.count() == 20 and table.filter("RF IS NULL OR RFM IS NULL").count() == 0
    counts = {(r["measure"], r["category"]): r["n"] for r in rf.group_counts(groups).collect()}
    assert sum(n for (m, _), n in counts.items() if m == C.RECENCY) == 21
    assert sum(n for (m, _), n in counts.items() if m == C.MONETARY) == 20
    bands = rf.rfm_bands(groups).filter(F.col("measure") == C.MONETARY).orderBy("rank").collect()
    assert bands[0]["ymin"] == 0 and bands[-1]["ymax"] == 1
    assert [b["ymin"] for b in bands[1:]] == [b["ymax"] for b in bands[:-1]]
    assert bands[0]["label"] == f"LOW\n  {bands[0]['n']}"


def test_degenerate_frequency_stops_the_job(spark):
    data = [(f"c{i}", f"t{i}", "x", f"2019-04-{1 + i:02d}", 1, 10 + i, 0) for i in range(10)]
    with pytest.raises(Exception, match="not strictly increasing"):
        rf.rfm_table(tickets(spark, data), "2019-01-01", "2019-04-30").collect()


def test_scores(spark):
    table = spark.createDataFrame(
        [(f"c{i}", 10 * i, i, Decimal(100 * i)) for i in range(1, 11)],
        f"{C.CUSTOMER} string, {C.RECENCY} int, {C.VISITS} bigint, {C.MONETARY} decimal(18,2)",
    )
    got = {r[C.CUSTOMER]: r["rfm_score"] for r in rf.rfm_scores(table).collect()}
    assert got["c1"] == 511 and got["c10"] == 155
    raster = rf.rfm_pairs(table, C.RECENCY, C.MONETARY, grid=3).collect()
    assert sum(r["n"] for r in raster) == 10 and all(r["x_bin"] == r["y_bin"] for r in raster)


def test_counts(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), (None, 1)], "k string, v int")
    assert rows(agg.level_counts(df, "k", ["x", "y", "z"])) == [("x", 2), ("y", 1), ("z", 0)]
    assert rows(agg.level_counts(df, "k")) == [("x", 2), ("y", 1)]
    wide = agg.cross_counts(df, "k", "v", pivot="v", pivot_values=[1, 2])
    assert rows(wide.filter("k IS NOT NULL")) == [("x", 1, 1), ("y", 1, 0)]
    assert rows(agg.article_sales(df, 1, "k")) == [("x", 2)]


def test_repurchase_gaps(lines):
    gaps = wd.repurchase_gaps(lines)
    assert rows(gaps) == [("a", dt.date(2019, 4, 20), 100), ("d", dt.date(2019, 3, 2), 1)]
    assert rows(wd.repurchase_curve(gaps)) == [(1, 1, 0.5), (100, 1, 1.0)]
    assert rows(wd.repurchase_quantiles(gaps, [0.5])) == [(0.5, 50.5)]
