"""Naive Bayes over numeric and categorical predictors together.

Numbers get a normal density per class, categories their share per class. Zero densities, shares and
deviations are replaced by a floor, and the evidence is added in log space.
"""

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..session import materialise

FLOOR = 0.001


@dataclass
class MixedNaiveBayes:
    """Fitted parameters: plain numbers per class, and a table (feature, level, shares per class)."""

    label: str
    numeric: tuple
    categorical: tuple
    classes: list
    rows: dict
    stats: dict
    shares: DataFrame
    floor: float

    def parameters(self):
        """All parameters in long form: class, feature, level, parameter, value."""
        total = sum(self.rows.values())
        small = []
        for c in self.classes:
            small.append((c, "(prior)", None, "share", self.rows[c] / total))
            for f in self.numeric:
                mean, sd = self.stats[c, f]
                small += [(c, f, None, "mean", mean), (c, f, None, "sd", sd)]
        schema = "class string, feature string, level string, parameter string, value double"
        numbers = self.shares.sparkSession.createDataFrame(small, schema)
        per_class = F.array(
            *[F.struct(F.lit(c).alias("class"), F.get("shares", F.lit(i)).alias("value")) for i, c in enumerate(self.classes)]
        )
        levels = self.shares.select("feature", "level", F.inline(per_class)).select(
            "class", "feature", "level", F.lit("share").alias("parameter"), "value"
        )
        return numbers.unionByName(levels)


def fit_bayes(train, label, numeric, categorical, floor=FLOOR):
    """Fit with two aggregations: one row per class, and one per (class, category level)."""
    per_class = (
        train.withColumn("_c", F.col(label).cast("string"))
        .groupBy("_c")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in numeric],
            *[F.stddev_samp(F.col(f).cast("double")).alias(f"s_{f}") for f in numeric],
        )
        .orderBy("_c")
        .collect()  # one row per class
    )
    classes = [r["_c"] for r in per_class]
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level")) for f in categorical])
    counts = (
        train.select(F.col(label).cast("string").alias("_c"), F.inline(pairs))
        .filter(F.col("level").isNotNull())
        .groupBy("feature", "level")
        .agg(*[F.count_if(F.col("_c") == c).alias(f"n{i}") for i, c in enumerate(classes)])
    )
    whole = counts.groupBy("feature").agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in range(len(classes))])
    shares = counts.join(whole, "feature").select(
        "feature",
        "level",
        F.array(*[F.try_divide(F.col(f"n{i}"), F.col(f"t{i}")) for i in range(len(classes))]).alias("shares"),
    )
    return MixedNaiveBayes(
        label=label,
        numeric=tuple(numeric),
        categorical=tuple(categorical),
        classes=classes,
        rows={r["_c"]: r["_n"] for r in per_class},
        stats={(r["_c"], f): (r[f"m_{f}"], r[f"s_{f}"]) for r in per_class for f in numeric},
        shares=materialise(shares),
        floor=floor,
    )


def _log_density(x, mean, sd, floor):
    if mean is None:
        return F.lit(math.log(floor))
    sd = sd if sd else floor
    z = (x - F.lit(mean)) / F.lit(sd)
    density = F.exp(F.lit(-0.5) * z * z) / F.lit(sd * math.sqrt(2 * math.pi))
    return F.log(F.when(density > 0, density).otherwise(F.lit(floor)))


def predict_bayes(model, df, key, positive="1"):
    """Rows (key, label, prediction, probability of ``positive``).

    Level shares are joined per category from a written table, whose size Spark knows; levels not seen in training
    score the floor. Missing predictors add nothing.
    """
    out = df
    for f in model.categorical:
        table = model.shares.filter(F.col("feature") == f).select(
            F.col("level").alias(f"_l_{f}"), F.col("shares").alias(f"_s_{f}")
        )
        out = out.join(table, F.col(f).cast("string") == F.col(f"_l_{f}"), "left")
    total = sum(model.rows.values())
    scores = []
    for i, c in enumerate(model.classes):
        score = F.lit(math.log(model.rows[c] / total))
        for f in model.numeric:
            x = F.col(f).cast("double")
            evidence = _log_density(x, *model.stats[c, f], model.floor)
            score = score + F.when(x.isNull(), F.lit(0.0)).otherwise(evidence)
        for f in model.categorical:
            share = F.get(F.col(f"_s_{f}"), F.lit(i))
            share = F.when(share > 0, share).otherwise(F.lit(model.floor))
            score = score + F.when(F.col(f).isNull(), F.lit(0.0)).otherwise(F.log(share))
        scores.append(score.alias(f"_score{i}"))
    scored = out.select(key, F.col(model.label).cast("string").alias("label"), *scores)
    cols = [F.col(f"_score{i}") for i in range(len(model.classes))]
    best = F.array_max(F.array(*cols))
    weights = [F.exp(s - best) for s in cols]
    first_best = F.array_position(F.array(*cols), best).cast("int")
    prediction = F.element_at(F.array(*[F.lit(c) for c in model.classes]), first_best)
    if positive in model.classes:
        probability = weights[model.classes.index(positive)] / sum(weights[1:], weights[0])
    else:
        probability = F.lit(0.0)
    return scored.select(key, "label", prediction.alias("prediction"), probability.alias("probability"))
