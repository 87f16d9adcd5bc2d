"""Running shares and gaps between purchases."""

from pyspark.sql import Window, functions as F

from .. import columns as C
from ..functions.arithmetic import fraction, midpoint
from ..functions.dates import days_between
from ..functions.text import concat_label
from .filters import purchases_only
from .quantiles import quantiles


def share_bands(counts, category="category", count="n", rank="rank", measure="measure"):
    """Share, running share before and after, label and label position per category.

    ``counts`` holds one row per (measure, category), a few rows per measure.
    """
    whole = Window.partitionBy(measure)
    so_far = whole.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(count).over(whole)
    done = F.sum(count).over(so_far)
    bands = counts.withColumns(
        {
            "fraction": fraction(F.col(count), total),
            "ymax": fraction(done, total),
            "ymin": fraction(done - F.col(count), total),
            "label": concat_label(F.col(category), F.col(count)),
        }
    )
    return bands.withColumn("labelPosition", midpoint(F.col("ymin"), F.col("ymax")))


def repurchase_gaps(df, customer=C.CUSTOMER, day=C.DAY):
    """Days between consecutive purchase days of each customer.

    Repeated days go first, so a customer brings at most one row per calendar day to the window.
    """
    days = purchases_only(df).select(customer, F.col(day).cast("date").alias("day")).distinct()
    per_customer = Window.partitionBy(customer).orderBy("day")
    gap = days_between(F.col("day"), F.lag("day").over(per_customer))
    return days.withColumn("gap", gap).filter(F.col("gap").isNotNull())


def repurchase_quantiles(gaps, probs=(0.8, 0.9), col="gap"):
    return quantiles(gaps, col, probs)


def repurchase_curve(gaps, col="gap"):
    """Share of gaps that are at most so many days, for every gap length that occurs."""
    counts = gaps.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    # one row per gap length in days: bounded by the calendar, so a single ordered window is enough
    running = Window.partitionBy(F.lit(1)).orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(F.lit(1))
    return counts.select(
        col, "n", fraction(F.sum("n").over(running), F.sum("n").over(everything)).alias("share")
    )
