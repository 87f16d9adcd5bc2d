"""Association rules: mining, redundancy, reports."""

from pyspark.sql import Window, functions as F

from ..session import materialise
from .aggregates import top
from .baskets import KEYS, frequent_baskets, itemsets, min_count
from .quantiles import PROFILE, quantile_table

TIES = ("antecedent", "consequent")
BLOCK = 256  # items per block of a basket in pair counting


def _measured(df, total):
    """Rule measures from the basket counts n (rule), n_a (antecedent) and n_c (consequent)."""
    n = F.col("n").cast("double")
    confidence = n / F.col("n_a")
    return df.select(
        "antecedent",
        "consequent",
        (n / total).alias("support"),
        confidence.alias("confidence"),
        (confidence / (F.col("n_c") / total)).alias("lift"),
        F.col("n").alias("count"),
        (F.col("n_a") / total).alias("coverage"),
    )


def rules_from_itemsets(sets, total, min_confidence=0.8):
    """All rules with one consequent item that frequent sets allow."""
    whole = F.lit(float(total))
    item = F.explode("items").alias("c")
    split = sets.filter(F.size("items") >= 2).select("items", F.col("freq").alias("n"), item)
    split = split.select(
        F.array_remove("items", F.col("c")).alias("antecedent"), F.array("c").alias("consequent"), "n"
    )
    left = sets.select(F.col("items").alias("antecedent"), F.col("freq").alias("n_a"))
    confident = split.join(left, "antecedent").filter(F.col("n").cast("double") / F.col("n_a") >= min_confidence)
    single = sets.filter(F.size("items") == 1).select(F.col("items").alias("consequent"), F.col("freq").alias("n_c"))
    return _measured(confident.join(single, "consequent"), whole)


def rules(b, min_support=0.001, min_confidence=0.8, max_len=None, num_partitions=None):
    """Association rules of baskets (items); ``max_len`` limits antecedent plus consequent."""
    sets, total = itemsets(materialise(b.select("items"), "baskets"), min_support, max_len, num_partitions)
    return rules_from_itemsets(sets, max(total, 1), min_confidence)


def rules_of_lines(
    lines, keys=KEYS, min_support=0.001, min_confidence=0.8, max_len=None, num_partitions=None
):
    """Association rules of distinct (basket key, item) rows; only short baskets are written and mined."""
    reduced, _, total = frequent_baskets(lines, keys, min_support)
    table = materialise(reduced.select("items"), "baskets")
    sets, total = itemsets(table, min_support, max_len, num_partitions, total)
    return rules_from_itemsets(sets, max(total, 1), min_confidence)


def pair_counts(lines, keys=KEYS, min_support=0.001, block=BLOCK):
    """Frequent pairs (a, b, n) with a < b, frequent items (item, n) and the number of baskets.

    What is left of a basket without its infrequent items is cut into blocks of ``block`` items, and
    pairs are formed per pair of blocks: equal pieces of different baskets are counted once with a
    weight, and the pieces of one huge basket are spread by the same shuffle.
    """
    grouped, items, total = frequent_baskets(lines, keys, min_support)
    sized = grouped.filter(F.size("items") > 1).withColumn(
        "blocks", F.ceil(F.size("items") / F.lit(block)).cast("int")
    )
    first = sized.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("blocks"))))
    both = first.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("blocks"))))

    def piece(i):
        return F.slice("items", (F.col(i) - 1) * block + 1, F.lit(block))

    pieces = both.select(
        piece("i").alias("left"), F.when(F.col("i") < F.col("j"), piece("j")).alias("right")
    )
    weighted = pieces.groupBy("left", "right").agg(F.count(F.lit(1)).alias("w"))
    pairs = (
        weighted.select("w", F.explode("left").alias("a"), F.coalesce("right", "left").alias("other"))
        .select("w", "a", F.explode("other").alias("b"))
        .filter(F.col("a") < F.col("b"))
        .groupBy("a", "b")
        .agg(F.sum("w").alias("n"))
        .filter(F.col("n") >= max(1, min_count(total, min_support)))
    )
    return pairs, items, total


def pair_rules(lines, keys=KEYS, min_support=0.001, min_confidence=0.8, block=BLOCK):
    """Rules between two single items, from distinct (basket key, item) rows."""
    pairs, items, total = pair_counts(lines, keys, min_support, block)
    both = F.array(*[F.struct(F.col(p).alias("x"), F.col(q).alias("y")) for p, q in (("a", "b"), ("b", "a"))])
    directed = pairs.select("n", F.inline(both))
    counted = directed.join(items.select(F.col("item").alias("x"), F.col("n").alias("n_a")), "x").join(
        items.select(F.col("item").alias("y"), F.col("n").alias("n_c")), "y"
    )
    named = counted.select("n", "n_a", "n_c", F.array("x").alias("antecedent"), F.array("y").alias("consequent"))
    sure = named.filter(F.col("n").cast("double") / F.col("n_a") >= min_confidence)
    return _measured(sure, F.lit(float(max(total, 1))))


def sort_rules(r, by="support"):
    """Rules in descending order of a measure, ties by antecedent and consequent."""
    return r.orderBy(F.desc(by), *[F.asc(t) for t in TIES])


def top_rules(r, by="support", k=10):
    return top(r, by, k, ties=TIES)


def rule_summary(r):
    """Rows (section, name, value): rule count, rules per size, quartiles and mean per measure."""
    measures = ["support", "confidence", "lift"]
    size = F.size("antecedent") + F.size("consequent")
    sizes = r.groupBy(size.cast("string").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    total = r.agg(F.lit("rules").alias("name"), F.count(F.lit(1)).cast("double").alias("value"))
    names = F.create_map(*[F.lit(x) for name, p in PROFILE for x in (p, name)])
    spread = quantile_table(r, {m: [p for _, p in PROFILE] for m in measures}).select(
        F.col("measure").alias("section"), F.element_at(names, F.col("prob")).alias("name"), "value"
    )
    wide = r.agg(*[F.avg(m).alias(m) for m in measures])
    pairs = F.array(
        *[F.struct(F.lit(m).alias("section"), F.lit("mean").alias("name"), F.col(m).alias("value")) for m in measures]
    )
    means = wide.select(F.inline(pairs))
    head = total.select(F.lit("total").alias("section"), "name", "value")
    return head.unionByName(sizes.select(F.lit("size").alias("section"), "name", "value")).unionByName(spread).unionByName(means)


def _item_set():
    return F.array_sort(F.array_union("antecedent", "consequent"))


def _containing(family):
    """Sets of a written ``family`` that strictly contain another of its sets; columns ``s`` (set), ``k`` (size).

    A set is compared with the smaller sets whose rarest item it holds.
    """
    members = family.select("s", "k", F.explode("s").alias("item"))
    rarity = members.groupBy("item").agg(F.count(F.lit(1)).alias("uses"))
    rarest = (
        members.join(rarity, "item")
        .groupBy("s", "k")
        .agg(F.min(F.struct("uses", "item")).alias("r"))
        .select(F.col("s").alias("sub"), F.col("k").alias("sub_k"), F.col("r.item").alias("item"))
    )
    holds = (F.col("sub_k") < F.col("k")) & (F.size(F.array_except("sub", "s")) == 0)
    return members.join(rarest, "item").filter(holds).select("s").distinct()


def redundant(r):
    """Rules with a flag ``redundant``.

    Rules rank by support, then smaller item sets, then confidence. A rule is redundant when an earlier
    rule has the same item set, or one contained in its own. A contained set has at least the support of
    the set, so it always ranks earlier. The rules are written once, because they are read several times.
    """
    with_set = materialise(r.withColumn("s", _item_set()), "rules")
    order = Window.partitionBy("s").orderBy(F.desc("confidence"), *[F.asc(t) for t in TIES])
    placed = with_set.withColumn("_place", F.row_number().over(order))
    family = materialise(with_set.select("s").distinct().withColumn("k", F.size("s")), "rule-sets")
    covered = _containing(family).withColumn("_covered", F.lit(True))
    flag = (F.col("_place") > 1) | F.coalesce("_covered", F.lit(False))
    return placed.join(covered, "s", "left").withColumn("redundant", flag).drop("s", "_place", "_covered")


def prune(r):
    """Rules that are not redundant."""
    return redundant(r).filter(~F.col("redundant")).drop("redundant")


def rule_points(r, k=10):
    """Support, confidence and lift of the ``k`` rules with the highest lift."""
    return top_rules(r, "lift", k).select("antecedent", "consequent", "support", "confidence", "lift")


def _text(col):
    return F.concat(F.lit("{"), F.array_join(col, ","), F.lit("}"))


def rule_grid(r, k=10, wide=False):
    """Antecedent by consequent with lift and support, in long form or with one lift column per consequent."""
    cells = top_rules(r, "lift", k).select(
        _text("antecedent").alias("lhs"), _text("consequent").alias("rhs"), "lift", "support"
    )
    return cells.groupBy("lhs").pivot("rhs").agg(F.max("lift")) if wide else cells


def rule_edges(r, limit=10):
    """Graph tables of the best rules: nodes (node, kind, support, lift) and edges (source, target)."""
    best = top_rules(r, "lift", limit).withColumn("rule", F.concat(_text("antecedent"), F.lit(" => "), _text("consequent")))
    into = best.select(F.explode("antecedent").alias("source"), F.col("rule").alias("target"), "support", "lift")
    out = best.select(F.col("rule").alias("source"), F.explode("consequent").alias("target"), "support", "lift")
    edges = into.unionByName(out)
    items = best.select(F.explode(F.array_union("antecedent", "consequent")).alias("node")).distinct()
    nodes = items.select("node", F.lit("item").alias("kind"), F.lit(None).cast("double").alias("support"), F.lit(None).cast("double").alias("lift"))
    return nodes.unionByName(best.select(F.col("rule").alias("node"), F.lit("rule").alias("kind"), "support", "lift")), edges
