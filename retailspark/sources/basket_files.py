"""Baskets as text: one line per basket, items joined by commas, neither header nor row numbers."""

from pyspark.sql import functions as F


def write_baskets(df, path, sep=","):
    """Write the ``items`` of each basket as one line; item names must not hold the separator."""
    clean = F.when(F.exists("items", lambda x: x.contains(sep)), F.raise_error(F.lit("item name holds the separator")))
    df.select(F.coalesce(clean.cast("string"), F.concat_ws(sep, "items")).alias("value")).write.text(path)


def read_baskets(spark, path, sep=","):
    """Baskets with an id and their distinct items; an empty line is a basket without items."""
    items = F.array_sort(F.array_distinct(F.split("value", f"\\Q{sep}\\E")))
    items = F.when(F.col("value") == "", F.array().cast("array<string>")).otherwise(items)
    lines = spark.read.text(path)
    return lines.select(F.monotonically_increasing_id().alias("basket"), items.alias("items"))
