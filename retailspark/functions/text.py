"""Text built from groups and labels."""

from pyspark.sql import functions as F


def join_members(items, sep=","):
    """One string per array of members, in member order."""
    return F.array_join(F.array_sort(items), sep)


def concat_label(category, count, sep="\n  "):
    """Chart label: category, line break, count."""
    return F.concat(category, F.lit(sep), count.cast("string"))
