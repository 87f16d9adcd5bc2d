"""Per-customer measures and count tables.

All of them are algebraic, so each task reduces its rows before the shuffle. Distinct tickets are
shuffled by (customer, ticket) first, which spreads a customer with very many rows over all tasks.
"""

from pyspark.sql import functions as F

from .. import columns as C
from ..functions.arithmetic import difference, sum_or_null
from ..functions.dates import as_day, days_between
from .filters import purchases_only


def net_amount(gross=C.GROSS, discount=C.DISCOUNT):
    return difference(gross, discount)


def recency(df, as_of, customer=C.CUSTOMER, day=C.DAY, last=C.LAST_PURCHASE, out=C.RECENCY):
    """Last purchase day per customer and the days from it to ``as_of``."""
    return (
        purchases_only(df)
        .groupBy(customer)
        .agg(F.max(F.col(day).cast("date")).alias(last))
        .withColumn(out, days_between(F.lit(as_day(as_of)), F.col(last)))
    )


def frequency(df, customer=C.CUSTOMER, ticket=C.TICKET, out=C.VISITS, method="exact", rsd=0.05):
    """Number of distinct purchase tickets per customer."""
    if method == "exact":
        count = F.count_distinct(F.col(ticket))
    elif method == "approx":
        count = F.approx_count_distinct(F.col(ticket), rsd)
    else:
        raise ValueError(f"method must be 'exact' or 'approx', not {method!r}")
    return purchases_only(df).groupBy(customer).agg(count.alias(out))


def monetary(df, customer=C.CUSTOMER, out=C.MONETARY, null_policy="propagate"):
    """Net amount per customer, refunds included."""
    return df.groupBy(customer).agg(sum_or_null(net_amount(), null_policy).alias(out))


def spend(df, customer=C.CUSTOMER, out=C.SPEND, null_policy="propagate"):
    """Gross amount, discount and their difference per customer, purchases only."""
    totals = purchases_only(df).groupBy(customer).agg(
        sum_or_null(F.col(C.GROSS), null_policy).alias(C.GROSS),
        sum_or_null(F.col(C.DISCOUNT), null_policy).alias(C.DISCOUNT),
    )
    return totals.withColumn(out, net_amount())


def distinct_keys(df, key=C.CUSTOMER):
    return df.select(key).distinct()


def level_counts(df, col, levels=None, out="n"):
    """Count per value of ``col``; with ``levels`` also zero rows for levels that do not occur."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))
    if levels is None:
        return counts
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in levels])).alias(col))
    return names.join(counts, col, "left").na.fill(0, [out])


def cross_counts(df, *cols, pivot=None, pivot_values=None, out="n"):
    """Count per combination of ``cols``; ``pivot`` spreads one of them over columns."""
    if pivot is None:
        return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(out))
    rows = [c for c in cols if c != pivot]
    wide = df.groupBy(*rows).pivot(pivot, list(pivot_values) if pivot_values else None).count()
    return wide.na.fill(0)


def article_sales(df, k=10, article=C.ARTICLE, out="NUM_VENDITE"):
    """The ``k`` articles with most ticket lines, ties by article; all of them with ``k=None``."""
    counts = df.groupBy(article).agg(F.count(F.lit(1)).alias(out))
    return counts if k is None else top(counts, out, k, ties=[article])


def ordered(df, by, descending=True, ties=()):
    """Sorted by ``by``, ties by the columns in ``ties`` ascending, so that the order is total."""
    first = F.desc(by) if descending else F.asc(by)
    return df.orderBy(first, *[F.asc(t) for t in ties])


def top(df, by, k=10, ties=(), descending=True):
    """First ``k`` rows of the sorted table; fewer rows are no error."""
    return ordered(df, by, descending, ties).limit(k)
