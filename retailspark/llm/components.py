"""Connected components of a graph given as edges, in joins over tables."""

from pyspark.sql import functions as F

from .repeats import written


def components(edges):
    """Rows (id, root) for the nodes of ``edges`` (a, b) that are not the least of their component.

    Every node hooks onto its least smaller neighbour, the chains are halved until each node points at its root, the
    edges move to the roots, and so on until no edge is left. The number of rounds is logarithmic; every table is
    written to the shared folder, and only counts reach the driver.
    """
    edges = written(_ordered(edges, "a", "b"), "edges")
    found = None
    while not edges.isEmpty():
        parents = written(edges.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "id"), "parents")
        parents = _halve(parents)
        if found is None:
            found = parents
        else:  # roots found before may have found roots of their own, and new nodes have come
            found = written(_follow(found, parents).unionByName(parents), "roots")
        moved = edges
        for end in ("hi", "lo"):
            moved = (
                moved.join(parents.withColumnRenamed("id", end), end, "left")
                .withColumn(end, F.coalesce("root", end))
                .drop("root")
            )
        edges = written(_ordered(moved, "hi", "lo"), "edges")
    if found is None:
        return edges.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
    return found.groupBy("id").agg(F.min("root").alias("root"))


def _ordered(edges, a, b):
    pairs = edges.where(F.col(a) != F.col(b))
    return pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()


def _follow(table, parents):
    up = parents.select(F.col("id").alias("root"), F.col("root").alias("above"))
    return table.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"))


def _halve(parents):
    while True:
        up = parents.select(F.col("id").alias("root"), F.lit(True).alias("inner"))
        if parents.join(up, "root", "left_semi").isEmpty():
            return parents
        parents = written(_follow(parents, parents), "parents")
