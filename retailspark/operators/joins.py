"""Equi-joins of tickets, customer tables and dimensions.

Joins carry no broadcast hint: Spark broadcasts a side when its size allows, and otherwise joins by shuffle,
where adaptive execution splits the partitions of hot keys. It can do so only where the join shuffles both sides
itself. A side grouped by the join key would come without a shuffle of its own, so ``key_set`` hands its keys on in
an expression that hides from the planner how they are dealt.
"""

from functools import reduce

from pyspark.sql import Window, functions as F

from .. import columns as C


def key_set(keys, on):
    """Distinct keys, as a side that the join shuffles itself."""
    return keys.select(on).distinct().select(F.element_at(F.array(on), 1).alias(on))


def restrict_to(df, keys, on=C.CUSTOMER):
    """Rows of ``df`` whose key occurs in ``keys``."""
    return df.join(key_set(keys, on), on, "left_semi")


def assemble(on, *dfs):
    """Inner join of per-key tables on one shared key."""
    return reduce(lambda left, right: left.join(right, on, "inner"), dfs)


def flag_members(df, keys, on=C.CUSTOMER, name=C.CHURN, present=0, absent=1):
    """``name`` is ``present`` where the key occurs in ``keys`` and ``absent`` elsewhere."""
    seen = key_set(keys, on).withColumn("_member", F.lit(True))
    flag = F.when(F.col("_member"), F.lit(present)).otherwise(F.lit(absent))
    return df.join(seen, on, "left").withColumn(name, flag).drop("_member")


def unique_by(dim, on, cols):
    """One row per key: the one with the smallest ``cols``, nulls last, as one value tuple."""
    order = [F.asc_nulls_last(c) for c in cols]
    first = Window.partitionBy(on).orderBy(*order)
    ranked = dim.select(on, *cols).distinct().withColumn("_row", F.row_number().over(first))
    return ranked.filter("_row = 1").drop("_row")


def enrich(df, dim, on, cols, unique=True):
    """Left join of the attributes ``cols`` of ``dim``.

    ``unique`` reduces a dimension with repeated keys to one row per key first, so that no row of
    ``df`` is multiplied.
    """
    chosen = unique_by(dim, on, cols) if unique else dim.select(on, *cols)
    return df.join(chosen, on, "left")


def enrich_via(df, bridge, dim, on=C.CUSTOMER, via=C.ADDRESS, cols=(C.REGION,), bridge_cols=(), unique=True):
    """Left join of ``cols`` of ``dim`` through ``bridge``; the bridge key is dropped afterwards.

    ``bridge_cols`` of the bridge are kept, which saves a second join to the same table.
    """
    step = enrich(df, bridge, on, [via, *bridge_cols], unique)
    return enrich(step, dim, via, list(cols), unique).drop(via)
