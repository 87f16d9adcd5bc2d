"""Retail views over a star schema of orders, order lines, parts, customers and nations."""

from pyspark.sql import functions as F

from .. import columns as C


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tickets(spark, folder, article="l_partkey"):
    """Ticket lines: each order is a ticket, each order line an article sold or returned.

    ``article`` may name a part attribute, such as ``p_type``; then the part table is joined.
    """
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_returnflag", "l_extendedprice", "l_discount"
    )
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    if article != "l_partkey":
        part = table(spark, folder, "part").select("p_partkey", article)
        joined = joined.join(part, joined.l_partkey == part.p_partkey)
    gross = F.col("l_extendedprice").cast(C.MONEY)
    return joined.select(
        F.col("o_custkey").alias(C.CUSTOMER),
        F.col("o_orderkey").alias(C.TICKET),
        F.col(article).alias(C.ARTICLE),
        F.col("o_orderdate").cast("date").alias(C.DAY),
        F.col("o_orderdate").alias(C.MOMENT),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias(C.DIRECTION),
        gross.alias(C.GROSS),
        (gross * F.col("l_discount").cast("decimal(4,2)")).alias(C.DISCOUNT),
    )


def accounts(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias(C.CUSTOMER),
        F.col("c_nationkey").alias(C.ADDRESS),
        F.col("c_mktsegment").alias(C.JOB),
    )


def addresses(spark, folder, level="r_name"):
    """Nation as address; its region (or its own name with ``n_name``) as REGION."""
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    return joined.select(F.col("n_nationkey").alias(C.ADDRESS), F.col(level).alias(C.REGION))


def loyalty(spark, folder, before):
    """Card type: the priority of the customer's last order before the given day."""
    orders = table(spark, folder, "orders").filter(F.col("o_orderdate") < F.lit(before))
    last = F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey"))
    return orders.groupBy(F.col("o_custkey").alias(C.CUSTOMER)).agg(last.alias(C.CARD))
