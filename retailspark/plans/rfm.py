"""Recency, frequency, monetary segmentation of active customers."""

from functools import reduce

from pyspark.sql import functions as F

from .. import columns as C
from ..functions import cut_expr, rf_segment, rfm_class, sum_or_null
from ..functions.dates import as_day, days_between
from ..operators.aggregates import cross_counts, level_counts, net_amount
from ..operators.filters import active_only, in_window, min_value
from ..operators.quantiles import with_breaks
from ..operators.windows import share_bands
from ..session import materialise

ACTIVE_DAYS = 95
FLOOR = "0.01"

# Break probabilities per measure. Frequency bins are closed on the left.
BREAKS = {
    C.RECENCY: (0.0, 0.25, 0.75, 1.0),
    C.VISITS: (0.0, 0.5, 0.75, 1.0),
    C.MONETARY: (0.0, 0.25, 0.75, 1.0),
}
GROUPS = {C.RECENCY: C.RECENCY_GROUP, C.VISITS: C.FREQUENCY_GROUP, C.MONETARY: C.MONETARY_GROUP}


def customer_measures(tickets, as_of, null_policy="propagate"):
    """Recency, frequency and monetary value of every customer with a purchase, in one aggregation.

    Recency and frequency count purchases only; the monetary value includes refunds.
    """
    bought = F.col(C.DIRECTION) == 1
    measures = tickets.groupBy(C.CUSTOMER).agg(
        F.max(F.when(bought, F.col(C.DAY))).alias(C.LAST_PURCHASE),
        F.count_distinct(F.when(bought, F.col(C.TICKET))).alias(C.VISITS),
        sum_or_null(net_amount(), null_policy).alias(C.MONETARY),
    )
    age = days_between(F.lit(as_day(as_of)), F.col(C.LAST_PURCHASE))
    return measures.filter(F.col(C.LAST_PURCHASE).isNotNull()).withColumn(C.RECENCY, age)


def rfm_groups(
    tickets,
    start,
    as_of,
    max_days=ACTIVE_DAYS,
    floor=FLOOR,
    when=C.DAY,
    on_degenerate="raise",
    method="exact",
    null_policy="propagate",
):
    """Measures and groups of all active customers.

    The breaks of each measure come from its own population: all active customers for recency and
    frequency, those above the floor for the monetary value. Customers below the floor stay, with a null
    monetary group.

    The measures, one short row per active customer, are written once: the tickets are scanned a single
    time, and quantiles and groups start from the small table.
    """
    chosen = in_window(tickets, when, lo=start, closed="neither")
    active = materialise(active_only(customer_measures(chosen, as_of, null_policy), max_days))
    above = F.when(F.col(C.MONETARY) > F.lit(str(floor)).cast("decimal(18,6)"), F.col(C.MONETARY))
    edged = with_breaks(active, active.withColumn(C.MONETARY, above), BREAKS, method=method)

    def group(measure, value, right=True):
        edges = F.col("_breaks_" + measure)
        return cut_expr(value, edges, C.LEVELS, right=right, on_degenerate=on_degenerate)

    grouped = edged.withColumns(
        {
            C.RECENCY_GROUP: group(C.RECENCY, F.col(C.RECENCY)),
            C.FREQUENCY_GROUP: group(C.VISITS, F.col(C.VISITS), right=False),
            C.MONETARY_GROUP: group(C.MONETARY, above),
        }
    )
    return grouped.select(*active.columns, *GROUPS.values())


def with_value(groups, floor=FLOOR):
    """The customers above the monetary floor, columns in reporting order."""
    return min_value(groups, C.MONETARY, floor).select(
        C.CUSTOMER,
        C.VISITS,
        C.FREQUENCY_GROUP,
        C.MONETARY,
        C.MONETARY_GROUP,
        C.LAST_PURCHASE,
        C.RECENCY,
        C.RECENCY_GROUP,
    )


def rfm_table(tickets, start, as_of, max_days=ACTIVE_DAYS, floor=FLOOR, **options):
    """One row per active customer above the monetary floor: measures and groups."""
    return with_value(rfm_groups(tickets, start, as_of, max_days, floor, **options), floor)


def rfm_segments(rfm):
    """Segment (RF) and class (RFM) per customer."""
    return rfm.withColumn("RF", rf_segment(C.RECENCY_GROUP, C.FREQUENCY_GROUP)).withColumn(
        "RFM", rfm_class("RF", C.MONETARY_GROUP)
    )


def rfm_scores(rfm, bins=5, method="exact"):
    """Scores 1..bins per measure and combined as 100 R + 10 F + M; recent purchases score high.

    ``rfm`` is read three times: materialise it first.
    """
    probs = [i / bins for i in range(bins + 1)]
    measures = (C.RECENCY, C.VISITS, C.MONETARY)
    edged = with_breaks(rfm, rfm, {m: probs for m in measures}, method=method)

    def score(measure):
        edges = F.col("_breaks_" + measure)
        return cut_expr(F.col(measure), edges, range(1, bins + 1), right=False, on_degenerate="collapse")

    r, f, m = F.lit(bins + 1) - score(C.RECENCY), score(C.VISITS), score(C.MONETARY)
    scored = edged.select(
        C.CUSTOMER,
        *measures,
        r.alias("recency_score"),
        f.alias("frequency_score"),
        m.alias("monetary_score"),
    )
    combined = F.col("recency_score") * 100 + F.col("frequency_score") * 10 + F.col("monetary_score")
    return scored.withColumn("rfm_score", combined)


def rfm_pairs(rfm, x, y, grid=None):
    """Points (x, y) per customer, or counts on a ``grid`` x ``grid`` raster when points are too many."""
    if grid is None:
        return rfm.select(C.CUSTOMER, F.col(x).alias("x"), F.col(y).alias("y"))
    points = rfm.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    points = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    span = points.agg(
        F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    ).scalar()

    points = points.withColumn("_span", span)

    def cell(value, lo, hi):
        place = F.floor(F.try_divide((value - lo) * grid, hi - lo)).cast("int") + 1
        return F.coalesce(F.least(place, F.lit(grid)), F.lit(1))

    raster = points.select(
        cell(F.col("x"), F.col("_span.x0"), F.col("_span.x1")).alias("x_bin"),
        cell(F.col("y"), F.col("_span.y0"), F.col("_span.y1")).alias("y_bin"),
    )
    return raster.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))


def group_counts(groups):
    """Customers per (measure, level), levels without customers as zero, in one pass.

    Every measure is counted over its own population: rows with a group for it.
    """
    pairs = [F.struct(F.lit(m).alias("measure"), F.col(g).alias("category")) for m, g in GROUPS.items()]
    counts = (
        groups.select(F.inline(F.array(*pairs)))
        .filter(F.col("category").isNotNull())
        .groupBy("measure", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cells = [
        F.struct(F.lit(m).alias("measure"), F.lit(level).alias("category"), F.lit(i + 1).alias("rank"))
        for m in GROUPS
        for i, level in enumerate(C.LEVELS)
    ]
    frame = groups.sparkSession.range(1).select(F.inline(F.array(*cells)))
    return frame.join(counts, ["measure", "category"], "left").na.fill(0, ["n"])


def rfm_bands(groups):
    """Shares and label positions of the three level distributions."""
    return share_bands(group_counts(groups))


def rfm_report(groups, floor=FLOOR):
    """The report tables by name. ``groups`` is read by each of them: materialise it first."""
    segments = rfm_segments(with_value(groups, floor))
    return {
        "bands": rfm_bands(groups),
        "rf": level_counts(segments, "RF"),
        "rfm": level_counts(segments, "RFM"),
        "rf_matrix": cross_counts(segments, C.RECENCY_GROUP, C.FREQUENCY_GROUP, "RF"),
        "rfm_matrix": cross_counts(segments, "RF", C.MONETARY_GROUP, "RFM"),
    }


def rfm_report_rows(groups, floor=FLOOR):
    """All counts of the report as one long table (section, name, n)."""
    report = rfm_report(groups, floor)

    def rows(section, *names):
        label = F.concat_ws("/", *names)
        return report[section].select(F.lit(section).alias("section"), label.alias("name"), "n")

    parts = [
        rows("bands", "measure", "category"),
        rows("rf", "RF"),
        rows("rfm", "RFM"),
        rows("rf_matrix", C.RECENCY_GROUP, C.FREQUENCY_GROUP, "RF"),
        rows("rfm_matrix", "RF", C.MONETARY_GROUP, "RFM"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
