"""Calendar expressions."""

import datetime as dt

from pyspark.sql import functions as F


def parse_day(col, pattern="d/M/yyyy"):
    """Day from text such as ``01/03/2019`` or ``1/3/2019``; null when it is no such day."""
    return F.try_to_timestamp(col, F.lit(pattern)).cast("date")


def as_day(value):
    """Literal day from a ``date``, an ISO string or ``dd/mm/yyyy``."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    if "/" in value:
        return dt.datetime.strptime(value, "%d/%m/%Y").date()
    return dt.date.fromisoformat(value)


def days_between(end, start):
    """Whole days from ``start`` to ``end``."""
    return F.datediff(end, start)
