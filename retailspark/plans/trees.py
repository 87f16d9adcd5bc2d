"""Reports on trees and forests: split gains, the pruning sequence, and out-of-bag estimates."""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from .. import columns as C
from ..operators.evaluation import poisson_weight
from ..session import materialise
from .churn import CATEGORICAL, NUMERIC, most_levels, stable_rows


def _gini(n, k):
    return 2 * (k / n) * (1 - k / n)


def split_gains(df, numeric=NUMERIC, categorical=CATEGORICAL, label=C.CHURN, bins=256):
    """Rows (predictor, gain, left_bins, left_rows, left_positives, below): the best first split of each predictor.

    gain is the fall of the Gini impurity, to nine digits; of equal gains the split with fewer bins on the left wins. A
    numeric predictor is cut into ``bins`` of equal width, and rows under ``below`` go left; a value of few steps has
    each in a bin of its own. Levels of a category are taken in the order of their share of positives, where the
    best split of two classes is always a prefix; its ``below`` is null. A predictor of one value has no row.

    One scan finds the ranges and one adds up rows and positives per bin, so only bins and levels are ranked.
    ``df`` has no missing predictors and labels 0 and 1.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in numeric], *categorical, F.col(label).cast("int").alias("y"))
    ends = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in numeric for f in (F.min, F.max)]).first()
    held, bound = [], F.lit(None).cast("double")
    for name in numeric:
        low, high = ends[f"min_{name}"], ends[f"max_{name}"]
        if low is None or low == high:
            continue
        width = (high - low) / bins
        place = F.least(F.lit(bins - 1), F.floor((F.col(name) - low) / width)).cast("long")
        held.append(F.struct(F.lit(name).alias("predictor"), place.alias("bin"), F.lit(None).cast("string").alias("level")))
        bound = F.when(F.col("predictor") == name, low + width * (F.col("bin") + 1)).otherwise(bound)
    for name in categorical:
        level = F.col(name).cast("string").alias("level")
        held.append(F.struct(F.lit(name).alias("predictor"), F.lit(None).cast("long").alias("bin"), level))
    counted = (
        rows.select("y", F.inline(F.array(*held)))
        .groupBy("predictor", "bin", "level")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"))
    )
    share = F.when(F.col("bin").isNull(), F.col("k") / F.col("n"))
    order = Window.partitionBy("predictor").orderBy("bin", share, "level")
    upto, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("predictor")
    sums = counted.select(
        "predictor",
        F.row_number().over(order).cast("long").alias("left_bins"),
        *[F.sum(c).over(upto).alias(f"left_{c}") for c in ("n", "k")],
        *[F.sum(c).over(whole).alias(f"all_{c}") for c in ("n", "k")],
        bound.alias("below"),
    ).where("left_n < all_n")
    n, k, left, hits = (F.col(c).cast("double") for c in ("all_n", "all_k", "left_n", "left_k"))
    gain = _gini(n, k) - left / n * _gini(left, hits) - (n - left) / n * _gini(n - left, k - hits)
    best = F.row_number().over(Window.partitionBy("predictor").orderBy(F.desc("gain"), "left_bins"))
    ranked = sums.withColumn("gain", F.round(gain, 9)).withColumn("place", best).where("place = 1")
    return ranked.select(
        "predictor", "gain", "left_bins", F.col("left_n").alias("left_rows"), F.col("left_k").alias("left_positives"), "below"
    )


def tree_shape(model):
    """A fitted tree as nested pairs of leaf numbers, from left to right as ``setLeafCol`` numbers them."""
    count = iter(range(model.numNodes))

    def shape(node):
        if node.subtreeDepth() == 0:
            return next(count)
        return shape(node.leftChild()), shape(node.rightChild())

    return shape(model._java_obj.rootNode())


def weakest_links(shape, train, test):
    """Rows (alpha, leaves, train_errors, test_errors) of the nested subtrees that cost-complexity pruning gives.

    ``train`` and ``test`` map a leaf's number to its rows of class 0 and of class 1. A node predicts the class that
    most of its training rows have, 0 if both are as many. alpha is the number of errors per leaf from which on a
    subtree is the best one; all links of one alpha go at once.
    """

    def counts(node, of):
        if isinstance(node, int):
            return of.get(node, (0, 0))
        return tuple(map(sum, zip(*(counts(child, of) for child in node))))

    def errors(node):  # leaves, training errors and test errors of the subtree
        if isinstance(node, tuple) and node[0] != "cut":
            return tuple(map(sum, zip(*map(errors, node))))
        node = node[1] if isinstance(node, tuple) else node
        zero, one = counts(node, train)
        other = 0 if one > zero else 1
        return 1, (zero, one)[other], counts(node, test)[other]

    def links(node):
        if isinstance(node, int) or node[0] == "cut":
            return []
        leaves, wrong, _ = errors(node)
        own = errors(("cut", whole(node)))[1]
        return [(own - wrong) / (leaves - 1), *links(node[0]), *links(node[1])]

    def whole(node):
        if isinstance(node, int):
            return node
        return whole(node[1]) if node[0] == "cut" else (whole(node[0]), whole(node[1]))

    def pruned(node, alpha):
        if isinstance(node, int) or node[0] == "cut":
            return node
        leaves, wrong, _ = errors(node)
        if (errors(("cut", whole(node)))[1] - wrong) / (leaves - 1) <= alpha:
            return "cut", whole(node)
        return pruned(node[0], alpha), pruned(node[1], alpha)

    rows, alpha = [], 0.0
    while True:
        while any(link <= alpha for link in links(shape)):
            shape = pruned(shape, alpha)
        rows.append((alpha, *errors(shape)))
        if rows[-1][1] == 1:
            return rows
        alpha = min(links(shape))


def tree_pruning(model, train, test):
    """Rows (subtree, alpha, leaves, train_errors, test_errors, train_rows, test_rows): the pruning sequence of a tree.

    Training and held-out rows are added up per leaf and class in one pass; the driver sees one row per leaf. alpha is
    the share of training rows that a leaf must save to stay.
    """
    model = model.setLeafCol("leaf")
    marked = train.select("tree_features", "label", F.lit(True).alias("fits"))
    marked = marked.unionByName(test.select("tree_features", "label", F.lit(False).alias("fits")))
    leaves = model.transform(marked).groupBy(F.col("leaf").cast("int").alias("leaf"), "fits")
    counted = leaves.agg(F.count_if(F.col("label") == 0).alias("zero"), F.count_if(F.col("label") == 1).alias("one")).collect()
    sides = [{r.leaf: (r.zero, r.one) for r in counted if r.fits == fits} for fits in (True, False)]
    n, m = (sum(map(sum, side.values())) for side in sides)
    rows = [
        (i, float(alpha / max(n, 1)), leaves, wrong, missed, n, m)
        for i, (alpha, leaves, wrong, missed) in enumerate(weakest_links(tree_shape(model), *sides))
    ]
    schema = "subtree int, alpha double, leaves int, train_errors long, test_errors long, train_rows long, test_rows long"
    return train.sparkSession.createDataFrame(rows, schema)


def bagged_rows(train, trees, key=C.CUSTOMER, seed=0):
    """Training rows with weights, an array of one Poisson(1) count per tree, drawn from seed, tree and key."""
    return train.withColumn("weights", F.array(*[poisson_weight(key, seed, i) for i in range(trees)]))


def bag_sizes(bagged, trees):
    """Rows (tree, weight, left_out, left_out_positives) of ``bagged_rows``."""
    out = lambda i: F.get("weights", F.lit(i)) == 0
    sums = [
        F.struct(
            F.lit(i).alias("tree"),
            F.sum(F.get("weights", F.lit(i))).alias("weight"),
            F.count_if(out(i)).alias("left_out"),
            F.count_if(out(i) & (F.col("label") == 1)).alias("left_out_positives"),
        )
        for i in range(trees)
    ]
    return bagged.agg(F.array(*sums).alias("s")).select(F.inline("s"))


def out_of_bag(train, encoder, trees=20, max_depth=5, key=C.CUSTOMER, seed=123456):
    """Rows (key, label, prediction, probability, judges): each training row as judged by the trees that did not see it.

    Every tree is trained on the rows with a weight above 0 in its bag, each node on a random choice of predictors, as
    in a forest; ``judges`` counts the trees that left the row out. A row that all trees saw has no prediction. The
    bags depend on keys only, so a lost task draws the same again.
    """
    bagged = materialise(stable_rows(bagged_rows(train, trees, key, seed).select(key, "label", "tree_features", "weights"), key), "bags")
    scored, votes = bagged, []
    for i in range(trees):
        weight = F.get("weights", F.lit(i))
        model = RandomForestClassifier(
            featuresCol="tree_features",
            weightCol="weight",
            numTrees=1,
            bootstrap=False,
            featureSubsetStrategy="sqrt",
            maxDepth=max_depth,
            maxBins=max(32, most_levels(encoder)),
            seed=seed + i,
        ).fit(bagged.withColumn("weight", weight.cast("double")).where("weight > 0"))
        model.setProbabilityCol("vote").setRawPredictionCol("").setPredictionCol("")
        scored = model.transform(scored).withColumn(f"vote_{i}", F.get(vector_to_array("vote"), F.lit(1))).drop("vote")
        votes.append(F.struct((weight == 0).alias("unseen"), F.col(f"vote_{i}").alias("p")))
    unseen = F.filter(F.array(*votes), lambda v: v["unseen"])
    total = F.aggregate(unseen, F.lit(0.0), lambda s, v: s + v["p"])
    judged = scored.select(key, F.col("label").cast("int"), F.size(unseen).alias("judges"), total.alias("total"))
    p = F.when(F.col("judges") > 0, F.col("total") / F.col("judges"))
    return judged.select(
        key,
        F.col("label").cast("string").alias("label"),
        F.when(p > 0.5, "1").when(p.isNotNull(), "0").alias("prediction"),
        p.alias("probability"),
        "judges",
    )
