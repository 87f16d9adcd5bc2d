"""Row filters and column projections."""

import datetime as dt

from pyspark.sql import functions as F, types as T

from .. import columns as C
from ..functions.dates import as_day


def _on_whole_days(df, col):
    return isinstance(df.schema[col].dataType, (T.TimestampType, T.TimestampNTZType))


def window_condition(df, col, lo=None, hi=None, closed="left"):
    """Condition for a day window on a date or timestamp column.

    On a timestamp column the ends are whole days too, written as bounds on the column itself so
    that they reach the file scan.
    """
    if closed not in ("left", "right", "both", "neither"):
        raise ValueError(f"closed must be left, right, both or neither, not {closed!r}")
    timestamps = _on_whole_days(df, col)
    step = dt.timedelta(days=1)
    c = F.col(col)
    condition = F.lit(True)
    if lo is not None:
        lo, included = as_day(lo), closed in ("left", "both")
        if timestamps:
            condition = c >= F.lit(lo if included else lo + step)
        else:
            condition = c >= F.lit(lo) if included else c > F.lit(lo)
    if hi is not None:
        hi, included = as_day(hi), closed in ("right", "both")
        if timestamps:
            upper = c < F.lit(hi + step if included else hi)
        else:
            upper = c <= F.lit(hi) if included else c < F.lit(hi)
        condition = upper if lo is None else condition & upper
    return condition


def in_window(df, col=C.DAY, lo=None, hi=None, closed="left"):
    """Rows whose day lies between ``lo`` and ``hi``; ``closed`` names the ends that belong to it."""
    return df.filter(window_condition(df, col, lo, hi, closed))


def purchases_only(df, direction=C.DIRECTION):
    return df.filter(F.col(direction) == 1)


def latest_rows(df, col=C.DAY):
    """Rows at the largest value of ``col``."""
    return df.filter(F.col(col) == df.select(F.max(col)).scalar())


def active_only(recency_df, max_days=95, col=C.RECENCY):
    return recency_df.filter(F.col(col) <= max_days)


def min_value(df, col=C.MONETARY, floor="0.01"):
    """Rows strictly above ``floor``; the floor is compared as a decimal, not a binary fraction."""
    return df.filter(F.col(col) > F.lit(str(floor)).cast("decimal(18,6)"))


def project(df, keep=None, drop=(), rename=None, copies=None, constants=None, casts=None):
    """Drop, cast, copy, add constants, rename and select, in that order and always by name."""
    out = df.drop(*drop) if drop else df
    for name, kind in (casts or {}).items():
        out = out.withColumn(name, F.col(name).cast(kind))
    added = {new: F.col(old) for new, old in (copies or {}).items()}
    added.update({name: F.lit(value) for name, value in (constants or {}).items()})
    if added:
        out = out.withColumns(added)
    if rename:
        out = out.withColumnsRenamed(rename)
    return out.select(*keep) if keep else out


def complete_cases(df, columns=None):
    """Rows without a null in any of ``columns`` (default: all)."""
    return df.na.drop("any", subset=list(columns) if columns else None)
