"""Train/test split that keeps the class shares."""

from decimal import Decimal

from pyspark.sql import Window, functions as F

PREFIX = 4  # hex digits: 65,536 buckets per class


def _per_label(table, label, *cols):
    """Scalar subquery with a map from label to ``cols``; ``table`` has one row per class."""
    entry = F.struct(F.col(label).cast("string").alias("k"), F.struct(*cols).alias("v"))
    return table.agg(F.map_from_entries(F.collect_list(entry))).scalar()


def assign_split(df, label, key, p=0.7, seed=123456, exact=True, out="is_train"):
    """``df`` with a boolean column that marks the training rows.

    ``exact`` marks, per class, the ceil(p*n) rows with the smallest md5(seed|key). The cut is found by
    counting hash prefixes; only the rows of one prefix per class are ranked, and the marking itself
    compares each row with the cut of its class, without a join. With ``exact=False`` a row is marked by its own hash alone, so the shares
    hold in expectation.
    """
    share = Decimal(str(p))
    hashed = df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))))
    if not exact:
        threshold = f"{int(share * 2**32):08x}"
        return hashed.withColumn(out, F.substring("_h", 1, 8) < threshold).drop("_h")
    digest = hashed.select(label, F.col(key).cast("string").alias("_k"), "_h")
    digest = digest.withColumn("_b", F.substring("_h", 1, PREFIX))
    whole = Window.partitionBy(label)
    upto = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        digest.groupBy(label, "_b")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"end": F.sum("n").over(upto), "total": F.sum("n").over(whole)})
        .withColumn("target", F.ceil(F.lit(share) * F.col("total")).cast("bigint"))
        .filter((F.col("end") - F.col("n") < F.col("target")) & (F.col("target") <= F.col("end")))
        .withColumn("need", F.col("target") - (F.col("end") - F.col("n")))
    )
    cut = F.try_element_at(_per_label(cuts, label, "_b", "need"), F.col(label).cast("string"))
    edge_rows = (
        digest.withColumn("_cut", cut)
        .filter(F.col("_b") == F.col("_cut._b"))
        .withColumn("_rn", F.row_number().over(Window.partitionBy(label).orderBy("_h", "_k")))
        .filter(F.col("_rn") == F.col("_cut.need"))
    )
    edge = F.try_element_at(_per_label(edge_rows, label, "_h", "_k"), F.col(label).cast("string"))
    place = F.struct(F.col("_h"), F.col(key).cast("string").alias("_k"))
    return hashed.withColumn(out, F.coalesce(place <= edge, F.lit(False))).drop("_h")


def stratified_split(df, label, key, p=0.7, seed=123456, exact=True):
    """Training and test rows; see ``assign_split``."""
    marked = assign_split(df, label, key, p, seed, exact, out="_train")
    return marked.filter("_train").drop("_train"), marked.filter("not _train").drop("_train")
