"""Arithmetic shared by the measures and the report tables."""

from pyspark.sql import functions as F


def difference(left, right):
    return F.col(left) - F.col(right)


def fraction(part, whole):
    """``part / whole`` as a double; null when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def midpoint(low, high):
    return (low + high) / F.lit(2.0)


def sum_or_null(expr, null_policy="propagate"):
    """Sum that is null as soon as one term is, or that skips nulls with ``ignore``."""
    if null_policy == "ignore":
        return F.sum(expr)
    if null_policy != "propagate":
        raise ValueError(f"null_policy must be 'propagate' or 'ignore', not {null_policy!r}")
    return F.when(F.count(expr) == F.count(F.lit(1)), F.sum(expr))
