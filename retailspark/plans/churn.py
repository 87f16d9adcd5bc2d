"""Churn: who buys in the lookback window but not in the holdout window."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import functions as F

from .. import columns as C
from ..functions.arithmetic import sum_or_null
from ..functions.dates import as_day, days_between
from ..operators.filters import complete_cases, in_window, purchases_only, window_condition
from ..operators.joins import enrich, enrich_via, flag_members
from ..operators.split import assign_split
from ..session import materialise

NUMERIC = (C.RECENCY, C.SPEND, C.PURCHASES)
CATEGORICAL = (C.REGION, C.JOB_CLEAN, C.CARD)


def churn_features(tickets, ref, lookback_start, when=C.DAY, null_policy="propagate"):
    """Recency, spend and tickets per customer over purchases in (lookback_start, ref)."""
    rows = purchases_only(in_window(tickets, when, lookback_start, ref, closed="neither"))
    return rows.groupBy(C.CUSTOMER).agg(
        days_between(F.lit(as_day(ref)), F.max(C.DAY)).alias(C.RECENCY),
        (sum_or_null(F.col(C.GROSS), null_policy) - sum_or_null(F.col(C.DISCOUNT), null_policy)).alias(C.SPEND),
        F.count_distinct(C.TICKET).alias(C.PURCHASES),
    )


def churn_label(features, tickets, ref, holdout_end, when=C.DAY):
    """CHURN is 0 for customers with a purchase in [ref, holdout_end), else 1."""
    buyers = purchases_only(in_window(tickets, when, ref, holdout_end, closed="left"))
    return flag_members(features, buyers, C.CUSTOMER, C.CHURN)


def labelled_features(tickets, ref, lookback_start, holdout_end, when=C.DAY, null_policy="propagate"):
    """Features and label from one scan and one aggregation of both windows."""
    both = purchases_only(in_window(tickets, when, lookback_start, holdout_end, closed="neither"))
    past = window_condition(tickets, when, lookback_start, ref, "neither")
    later = ~past  # the scan ends at holdout_end and starts after lookback_start
    gross = F.sum(F.when(past, F.col(C.GROSS)))
    discount = F.sum(F.when(past, F.col(C.DISCOUNT)))
    spend = gross - discount
    if null_policy == "propagate":
        whole = (F.count_if(past & F.col(C.GROSS).isNull()) == 0) & (F.count_if(past & F.col(C.DISCOUNT).isNull()) == 0)
        spend = F.when(whole, spend)
    measured = both.groupBy(C.CUSTOMER).agg(
        days_between(F.lit(as_day(ref)), F.max(F.when(past, F.col(C.DAY)))).alias(C.RECENCY),
        spend.alias(C.SPEND),
        F.count_distinct(F.when(past, F.col(C.TICKET))).alias(C.PURCHASES),
        F.when(F.max(F.when(later, 1)) == 1, 0).otherwise(1).alias(C.CHURN),
    )
    return measured.filter(F.col(C.RECENCY).isNotNull())


def churn_dataset(
    tickets,
    accounts,
    loyalty,
    addresses,
    ref,
    lookback_start,
    holdout_end,
    when=C.DAY,
    null_policy="propagate",
    unique=True,
):
    """Labelled customers with job, card and region; rows with a missing value are dropped.

    ``unique=False`` says that the three tables already have one row per key, which saves reducing them.
    """
    base = labelled_features(tickets, ref, lookback_start, holdout_end, when, null_policy)
    jobs = accounts.withColumn(C.JOB_CLEAN, F.col(C.JOB))
    # joins on the customer first: they share one partitioning, only the address needs another
    carded = enrich(base, loyalty, C.CUSTOMER, [C.CARD], unique)
    placed = enrich_via(carded, jobs, addresses, cols=(C.REGION,), bridge_cols=(C.JOB_CLEAN,), unique=unique)
    return complete_cases(
        placed.select(C.CUSTOMER, *NUMERIC, C.CHURN, C.JOB_CLEAN, C.CARD, C.REGION)
    )


MOST_LEVELS = 100_000  # levels of a category that the driver and the model can hold


def encode(df, numeric=NUMERIC, categorical=CATEGORICAL, label=C.CHURN, most_levels=MOST_LEVELS):
    """Model input: level indices, indicator columns with the alphabetically first level as base, and the
    vectors ``features`` (for linear models) and ``tree_features``. Fit on all rows, before the split.

    A category with one level has no indicators. The driver keeps the names of all levels, so a category with more
    than ``most_levels`` of them raises. Returns the fitted stages and the encoded rows. ``df`` is read several times:
    materialise it first.
    """
    levels = df.agg(*[F.approx_count_distinct(c).alias(c) for c in categorical]).first()
    for name in categorical:
        if levels[name] > most_levels:
            raise ValueError(f"category {name} has about {levels[name]} levels, more than most_levels={most_levels}")
    index = [f"{c}_index" for c in categorical]
    dummies = [f"{c}_dummies" for c in categorical]
    values = [f"{c}_value" for c in numeric]
    plain = df.withColumns(
        {**{v: F.col(c).cast("double") for v, c in zip(values, numeric)}, "label": F.col(label).cast("double")}
    )
    indexer = StringIndexer(
        inputCols=list(categorical), outputCols=index, stringOrderType="alphabetDesc", handleInvalid="error"
    ).fit(plain)
    several = [i for i, names in enumerate(indexer.labelsArray) if len(names) > 1]
    stages = [indexer]
    if several:
        stages.append(
            OneHotEncoder(inputCols=[index[i] for i in several], outputCols=[dummies[i] for i in several], dropLast=True)
        )
    stages += [
        VectorAssembler(inputCols=[*values, *[dummies[i] for i in several]], outputCol="features"),
        VectorAssembler(inputCols=[*values, *index], outputCol="tree_features"),
    ]
    fitted = Pipeline(stages=stages).fit(plain)
    return fitted, fitted.transform(plain)


def training_tables(df, p=0.7, seed=123456, exact=True, label=C.CHURN, key=C.CUSTOMER):
    """Encoder, training rows and test rows of a churn data set.

    Two small tables are written: the customers, so that the tickets are scanned once, and the encoded
    customers with their split mark, because every training pass reads them.
    """
    rows = materialise(df, "customers")
    encoder, encoded = encode(rows, label=label)
    marked = materialise(assign_split(encoded, label, key, p, seed, exact), "encoded")
    return encoder, marked.filter("is_train"), marked.filter("not is_train")


def term_names(encoder, numeric=NUMERIC, categorical=CATEGORICAL):
    """Names of the entries of ``features``."""
    terms = list(numeric)
    for column, levels in zip(categorical, encoder.stages[0].labelsArray):
        terms += [f"{column}{level}" for level in levels[:-1]]
    return terms


def stable_rows(df, key=C.CUSTOMER, partitions=None):
    """Rows placed and sorted by the hash of the key, so that seeded training repeats exactly."""
    placed = df.repartition(partitions, key) if partitions else df.repartition(key)
    return placed.sortWithinPartitions(key)


def most_levels(encoder):
    return max(2, *[len(levels) for levels in encoder.stages[0].labelsArray])


def decision_tree(train, encoder, max_depth=5, seed=123456):
    model = DecisionTreeClassifier(
        featuresCol="tree_features", maxDepth=max_depth, maxBins=max(32, most_levels(encoder)), seed=seed
    )
    return model.fit(stable_rows(train))


def random_forest(train, encoder, trees=100, max_depth=5, seed=123456):
    model = RandomForestClassifier(
        featuresCol="tree_features",
        numTrees=trees,
        maxDepth=max_depth,
        maxBins=max(32, most_levels(encoder)),
        seed=seed,
    )
    return model.fit(stable_rows(train))


def logistic_regression(train):
    """Unpenalised logistic regression, trained at any number of rows and terms."""
    return LogisticRegression(featuresCol="features", regParam=0.0).fit(train)


def _linear_fit(train):
    return GeneralizedLinearRegression(featuresCol="features", family="binomial", link="logit").fit(train)


def logistic_summary(train):
    """One row: null and residual deviance with their degrees of freedom, and AIC."""
    summary = _linear_fit(train).summary
    row = (
        float(summary.nullDeviance),
        int(summary.residualDegreeOfFreedomNull),
        float(summary.deviance),
        int(summary.residualDegreeOfFreedom),
        float(summary.aic),
    )
    schema = "null_deviance double, null_df long, residual_deviance double, residual_df long, aic double"
    return train.sparkSession.createDataFrame([row], schema)


def fitted_totals(model, train, encoder):
    """Rows (term, observed, fitted): over the training rows, the sum of each indicator (and of 1) times the label,
    and times the probability that ``model`` gives. At the optimum of an unpenalised logistic regression both agree."""
    scored = model.transform(train)
    p = F.get(vector_to_array("probability"), F.lit(1))
    names = [*term_names(encoder), "(Intercept)"]
    values = F.concat(vector_to_array("features"), F.array(F.lit(1.0)))
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("term"), values.alias("x"))
    long = scored.select("label", p.alias("p"), F.inline(pairs)).toDF("label", "p", "term", "x")
    return long.groupBy("term").agg(
        F.sum(F.col("x") * F.col("label")).alias("observed"), F.sum(F.col("x") * F.col("p")).alias("fitted")
    )


def leaf_shares(model, train):
    """Rows (leaf, n, positives, probability) of a decision tree: each leaf's training rows and its probability."""
    scored = model.setLeafCol("leaf").transform(train)
    return scored.groupBy(F.col("leaf").cast("int").alias("leaf")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label").alias("positives"),
        F.max(F.get(vector_to_array("probability"), F.lit(1))).alias("probability"),
    )


def logistic_coefficients(train, encoder):
    """Coefficient table with standard errors, z values and p values."""
    fit = _linear_fit(train)
    summary = fit.summary
    names = [*term_names(encoder), "(Intercept)"]
    estimates = [*[float(x) for x in fit.coefficients], float(fit.intercept)]
    rows = list(
        zip(names, estimates, summary.coefficientStandardErrors, summary.tValues, summary.pValues, strict=True)
    )
    schema = "term string, estimate double, std_error double, z_value double, p_value double"
    return train.sparkSession.createDataFrame([(n, *map(float, v)) for n, *v in rows], schema)


def resampled_accuracy(train, folds=5, seed=123456):
    """Cross-validated accuracy of the logistic regression."""
    lr = LogisticRegression(featuresCol="features", regParam=0.0)
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    cv = CrossValidator(
        estimator=lr, estimatorParamMaps=[{}], evaluator=judge, numFolds=folds, seed=seed
    ).fit(train)
    spark = train.sparkSession
    return spark.createDataFrame([(folds, float(cv.avgMetrics[0]))], "folds int, accuracy double")


def tree_rules(tree, spark):
    """The text of a fitted tree as rows (line, rule)."""
    lines = [(i, text) for i, text in enumerate(tree.toDebugString.splitlines())]
    return spark.createDataFrame(lines, "line int, rule string")


def tree_importances(tree, spark, numeric=NUMERIC, categorical=CATEGORICAL):
    """Importance per predictor of a tree or forest."""
    names = [*numeric, *categorical]
    rows = [(n, float(tree.featureImportances[i])) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "feature string, importance double")


def tree_complexity(train, encoder, depths=(1, 2, 3, 4, 5), train_ratio=0.75, seed=123456):
    """Accuracy on held-out training rows per tree depth."""
    tree = DecisionTreeClassifier(featuresCol="tree_features", maxBins=max(32, most_levels(encoder)), seed=seed)
    grid = ParamGridBuilder().addGrid(tree.maxDepth, list(depths)).build()
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    search = TrainValidationSplit(
        estimator=tree, estimatorParamMaps=grid, evaluator=judge, trainRatio=train_ratio, seed=seed
    ).fit(stable_rows(train))
    rows = [(d, float(a)) for d, a in zip(depths, search.validationMetrics)]
    return train.sparkSession.createDataFrame(rows, "max_depth int, accuracy double")


def predict(model, df, key=C.CUSTOMER):
    """Rows (key, label, prediction, probability of class 1), classes as text."""
    scored = model.transform(df)
    return scored.select(
        key,
        F.col("label").cast("int").cast("string").alias("label"),
        F.col("prediction").cast("int").cast("string").alias("prediction"),
        F.get(vector_to_array("probability"), F.lit(1)).alias("probability"),
    )
