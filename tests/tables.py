"""Hand-made ticket lines, and what the tests share."""

import datetime as dt
from decimal import Decimal

from retailspark import columns as C

SMALL = "/root/testdata/sf0.001"


def day(text):
    return dt.date.fromisoformat(text)


def tickets(spark, lines):
    """``lines``: (customer, ticket, article, ISO day, direction, gross, discount), nulls allowed."""
    data = [
        (
            c,
            t,
            a,
            day(d) if d else None,
            dt.datetime.fromisoformat(d) if d else None,
            direction,
            None if gross is None else Decimal(str(gross)),
            None if discount is None else Decimal(str(discount)),
        )
        for c, t, a, d, direction, gross, discount in lines
    ]
    return spark.createDataFrame(data, C.TICKET_SCHEMA)


def rows(df, *by):
    """Rows as tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
