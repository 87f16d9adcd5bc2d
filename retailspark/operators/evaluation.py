"""Confusion counts and quality measures of class predictions."""

from functools import reduce
from math import exp, factorial

from pyspark.sql import functions as F


def confusion(pred, label="label", prediction="prediction"):
    """Count per (label, prediction)."""
    return pred.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def _ratio(a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


def metrics(pred, positive="1", label="label", prediction="prediction", by=()):
    """One row of measures, or one per value of ``by``, from a single aggregation."""
    truth, guess = F.col(label) == positive, F.col(prediction) == positive
    counts = pred.groupBy(*by).agg(
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(~truth & ~guess).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    observed = _ratio(tp + tn, n)
    chance = _ratio((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return counts.select(
        *by,
        "tp",
        "fp",
        "fn",
        "tn",
        observed.alias("accuracy"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tn, tn + fp).alias("specificity"),
        _ratio(tp, tp + fp).alias("precision"),
        F.try_divide(observed - chance, F.lit(1.0) - chance).alias("kappa"),
        _ratio(F.greatest(tp + fn, fp + tn), n).alias("no_information_rate"),
        _ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1"),
    )


def confusion_report(pred, positive="1"):
    """One row more of the same counts: balanced accuracy, negative predictive value, prevalence, detection rate,
    detection prevalence, and the McNemar statistic with continuity correction."""
    m = metrics(pred, positive)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    wrong = F.col("fp") + F.col("fn")
    gap = F.abs(F.col("fp") - F.col("fn")) - 1
    return m.select(
        ((F.col("recall") + F.col("specificity")) / 2).alias("balanced_accuracy"),
        F.try_divide(F.col("tn"), F.col("tn") + F.col("fn")).alias("negative_predictive_value"),
        F.try_divide(F.col("tp") + F.col("fn"), n).alias("prevalence"),
        F.try_divide(F.col("tp"), n).alias("detection_rate"),
        F.try_divide(F.col("tp") + F.col("fp"), n).alias("detection_prevalence"),
        F.try_divide((gap * gap).cast("double"), wrong).alias("mcnemar"),
    )


def f1(pred, positive="1", label="label", prediction="prediction"):
    return metrics(pred, positive, label, prediction).select("f1")


def compare_models(predictions, positive="1"):
    """Accuracy and F1 per model; ``predictions`` maps a name to a table (label, prediction)."""
    parts = [
        p.select(F.lit(name).alias("model"), F.col("label").cast("string"), F.col("prediction").cast("string"))
        for name, p in predictions.items()
    ]
    union = reduce(lambda a, b: a.unionByName(b), parts)
    return metrics(union, positive, by=("model",)).select("model", "accuracy", "f1")


def poisson_thresholds(most=12):
    """Numbers below 2**32: one drawn evenly from there has a Poisson(1) count of thresholds not above it."""
    terms = [exp(-1) / factorial(k) for k in range(most)]
    return [int(sum(terms[: k + 1]) * 2**32) for k in range(most)]


def poisson_weight(key, seed, i):
    """Poisson(1) count of a row in sample ``i``, from the digest of seed, sample and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}-{i}-"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    drawn = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return reduce(lambda a, b: a + b, [(drawn >= t).cast("long") for t in poisson_thresholds()])


def bootstrap_accuracy(pred, key, repeats=25, seed=0, label="label", prediction="prediction"):
    """Rows (repeat, n, accuracy): accuracy on ``repeats`` bootstrap samples of given predictions.

    A row's weight in a sample is a Poisson(1) count drawn from the digest of seed, repeat and key, so samples do not
    depend on the partitioning, and all of them are added up in one pass without copying rows.
    """
    right = F.when(F.col(label) == F.col(prediction), 1).otherwise(0)
    sums = []
    for i in range(repeats):
        weight = poisson_weight(key, seed, i)
        sums.append(F.struct(F.lit(i).alias("repeat"), F.sum(weight).alias("n"), F.sum(weight * right).alias("hits")))
    return pred.agg(F.array(*sums).alias("s")).select(F.inline("s")).select(
        "repeat", "n", _ratio(F.col("hits"), F.col("n")).alias("accuracy")
    )
