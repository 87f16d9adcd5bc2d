"""Baskets, item frequencies and frequent item sets."""

from decimal import ROUND_CEILING, Decimal
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from .. import columns as C
from ..session import materialise
from .aggregates import top
from .quantiles import PROFILE, quantile_table

KEYS = (C.CUSTOMER, C.MOMENT)


def basket_lines(tickets, keys=KEYS, item=C.ARTICLE):
    """Distinct (basket key, item) rows; a basket whose articles are all missing counts as a basket without items and
    keeps a row with a null item. The long form is shuffled by key and item together, so one very large basket is
    spread over many tasks."""
    return tickets.select(*keys, F.col(item).cast("string").alias("item")).distinct()


def baskets(tickets, keys=KEYS, item=C.ARTICLE):
    """One row per basket with its sorted set of items; refunds count as items too.

    For results that are arrays; what only counts takes ``basket_lines``. A set holds each item once, so its size is
    bounded by the number of articles.
    """
    return tickets.groupBy(*keys).agg(F.sort_array(F.collect_set(F.col(item).cast("string"))).alias("items"))


def article_lists(tickets, keys=KEYS, item=C.ARTICLE, sep=","):
    """All articles of each basket as one sorted text, as often as they stand on its lines; lines are counted first,
    so that what meets per basket is one row per article."""
    counts = tickets.groupBy(*keys, F.col(item).cast("string").alias("item")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("item", "n"))))
    repeated = F.flatten(F.transform(pairs, lambda p: F.array_repeat(p["item"], p["n"])))
    return counts.groupBy(*keys).agg(F.array_join(repeated, sep).alias("items"))


def item_counts(lines):
    """Number of baskets per item, from distinct (basket key, item) rows."""
    return lines.filter("item is not null").groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def item_frequency(lines, k=10):
    """The ``k`` items found in most baskets."""
    return top(item_counts(lines), "n", k, ties=["item"])


def basket_summary(lines, keys=KEYS, k=5):
    """Rows (section, name, value): totals, density, basket sizes and the most frequent items.

    ``lines`` are distinct (basket key, item) rows, read three times: write them first.
    """
    sizes = lines.groupBy(*keys).agg(F.count("item").cast("int").alias("size"))
    per_size = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    totals = per_size.agg(F.sum("n").alias("baskets"), F.sum(F.col("size") * F.col("n")).alias("lines"))
    counts = item_counts(lines)
    totals = totals.withColumn("kinds", counts.agg(F.count(F.lit(1))).scalar())
    filled = F.col("lines").cast("double")
    values = {
        "baskets": F.col("baskets").cast("double"),
        "items": F.col("kinds").cast("double"),
        "density": F.try_divide(filled, F.col("baskets") * F.col("kinds")),
        "mean size": F.try_divide(filled, F.col("baskets")),
    }
    entries = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in values.items()])
    head = totals.select(F.lit("total").alias("section"), F.inline(entries))
    dist = per_size.select(F.lit("size"), F.col("size").cast("string"), F.col("n").cast("double"))
    names = F.create_map(*[F.lit(x) for name, p in PROFILE for x in (p, name)])
    spread = quantile_table(sizes, {"size": [p for _, p in PROFILE]}).select(
        F.lit("size quantile"), F.element_at(names, F.col("prob")), "value"
    )
    frequent = top(counts, "n", k, ties=["item"]).select(F.lit("item"), "item", F.col("n").cast("double"))
    return head.union(dist).union(spread).union(frequent)


def frequent_items(lines, keys=KEYS, min_support=0.001):
    """Frequent items (item, n) of distinct (basket key, item) rows, and the number of baskets, those without items
    included."""
    total = lines.select(*keys).distinct().count()
    return item_counts(lines).filter(F.col("n") >= max(1, min_count(total, min_support))), total


def frequent_baskets(lines, keys=KEYS, min_support=0.001):
    """Baskets (keys, items) reduced to their frequent items, sorted, without those that have none; the
    frequent items (item, n); and the number of all baskets.

    The distinct lines are written once, so tickets are read and shuffled a single time, and each later
    pass reads the columns it needs. Infrequent items go before baskets are formed. The arrays are short
    whatever a basket holds: there are at most mean basket size / min_support frequent items.
    """
    written = materialise(lines, "lines")
    counts, total = frequent_items(written, keys, min_support)
    items = materialise(counts, "items")
    kept = written.join(items.select("item"), "item", "left_semi")
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("item")).alias("items")), items, total


def min_count(total, min_support):
    """Smallest basket count that reaches the support share."""
    return int((Decimal(str(min_support)) * total).to_integral_value(rounding=ROUND_CEILING))


def itemsets(b, min_support=0.001, max_len=None, num_partitions=None, total=None):
    """Frequent item sets (items, freq) of a written basket table, and the number of baskets.

    ``total`` is the number of all baskets when ``b`` leaves out those without frequent items. Without ``max_len``
    Spark's FP-growth mines sets of all sizes; the driver holds the frequent items only, at most mean basket size /
    min_support of them. With it sets are mined level by level, and no set above that size is formed. The sets are
    written once, because the rules read them three times and mining is the dear part.
    """
    rows = b.count()
    total = rows if total is None else total
    wanted = max(1, min_count(total, min_support))
    if wanted > rows:
        return b.select("items", F.lit(0).cast("bigint").alias("freq")).limit(0), total
    if max_len is not None:
        return materialise(_levels(b, wanted, max_len), "itemsets"), total
    # half a basket below the wanted count: the miner rounds share * rows up again
    miner = FPGrowth(itemsCol="items", minSupport=(wanted - 0.5) / rows)
    if num_partitions:
        miner.setNumPartitions(num_partitions)
    sets = miner.fit(b.select("items")).freqItemsets
    return materialise(sets.select(F.sort_array("items").alias("items"), "freq"), "itemsets"), total


def _levels(b, wanted, max_len):
    """Frequent sets of up to ``max_len`` items.

    Equal baskets are one row with a weight. A set of k items is a candidate if the two it has without its last and
    without its last but one item are frequent; where a basket holds the first of these, it is looked up for the other
    item by equality.
    """
    weighted = b.filter(F.size("items") > 0).groupBy("items").agg(F.count(F.lit(1)).alias("w"))
    weighted = materialise(weighted.withColumn("basket", F.monotonically_increasing_id()), "weighted")
    lines = materialise(weighted.select("basket", "w", F.explode("items").alias("item")), "weighted-lines")

    def counted(found):
        return found.groupBy("items").agg(F.sum("w").alias("freq")).filter(F.col("freq") >= wanted)

    held = lines.select("basket", "w", F.array("item").alias("items"))
    level = materialise(counted(held), "level")
    levels = [level]
    for size in range(2, max_len + 1):
        held = held.join(level.select("items"), "items", "left_semi")
        head, last = F.slice("items", 1, size - 2), F.element_at("items", -1)
        a = level.select(head.alias("head"), last.alias("x"))
        c = level.select(head.alias("head"), last.alias("item"))
        pairs = a.join(c, "head").filter(F.col("x") < F.col("item"))
        candidates = pairs.select(F.concat("head", F.array("x")).alias("items"), "item")
        grown = held.join(candidates, "items").join(lines.select("basket", "item"), ["basket", "item"], "left_semi")
        held = materialise(grown.select("basket", "w", F.concat("items", F.array("item")).alias("items")), "held")
        level = materialise(counted(held), "level")
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(lambda x, y: x.unionByName(y), levels)
