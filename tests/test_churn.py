import pytest
from pyspark.sql import functions as F
from tables import rows, tickets

from retailspark import columns as C
from retailspark.operators import evaluation as ev
from retailspark.plans import churn as ch

LINES = [
    ("stays", "t1", "x", "2018-10-02", 1, 10, 1),
    ("stays", "t2", "x", "2018-12-31", 1, 5, 0),
    ("stays", "t3", "x", "2019-01-01", 1, 5, 0),  # first holdout day
    ("late", "t4", "x", "2018-11-01", 1, 5, 0),
    ("late", "t5", "x", "2019-03-01", 1, 5, 0),  # after the holdout
    ("refund", "t6", "x", "2018-11-01", 1, 5, 0),
    ("refund", "t7", "x", "2019-01-15", -1, 5, 0),  # a refund is no purchase
    ("edge", "t8", "x", "2018-10-01", 1, 5, 0),  # on the excluded edge
    ("new", "t9", "x", "2019-02-01", 1, 5, 0),
    ("gap", "t10", "x", "2018-12-01", 1, None, 0),
]
ARGS = ("2019-01-01", "2018-10-01")


def test_features_and_labels(spark):
    lines = tickets(spark, LINES)
    features = ch.churn_features(lines, *ARGS)
    labelled = ch.churn_label(features, lines, "2019-01-01", "2019-03-01")
    got = {r[C.CUSTOMER]: tuple(r)[1:] for r in labelled.collect()}
    assert set(got) == {"stays", "late", "refund", "gap"}
    assert got["stays"][0] == 1 and float(got["stays"][1]) == 14 and got["stays"][2:] == (2, 0)
    assert got["late"][3] == 1 and got["refund"][3] == 1 and got["gap"][1] is None
    for when in (C.DAY, C.MOMENT):
        fused = ch.labelled_features(lines, *ARGS, "2019-03-01", when=when)
        assert rows(fused) == rows(labelled)


def test_null_policy_of_the_fused_form(spark):
    lines = tickets(spark, LINES)
    fused = ch.labelled_features(lines, *ARGS, "2019-03-01", null_policy="ignore")
    single = ch.churn_features(lines, *ARGS, null_policy="ignore")
    assert rows(fused.drop(C.CHURN)) == rows(single)


def test_dataset_drops_incomplete_rows(spark):
    accounts = spark.createDataFrame(
        [("stays", "A1", "clerk"), ("late", "A2", None), ("refund", "A9", "clerk")],
        "ID_CLI string, ID_ADDRESS string, TYP_JOB string",
    )
    loyalty = spark.createDataFrame([(c, "STANDARD") for c in ("stays", "late", "refund")], "ID_CLI string, LAST_COD_FID string")
    addresses = spark.createDataFrame([("A1", "North"), ("A2", "South")], "ID_ADDRESS string, REGION string")
    got = ch.churn_dataset(tickets(spark, LINES), accounts, loyalty, addresses, *ARGS, "2019-03-01")
    assert [r[C.CUSTOMER] for r in got.collect()] == ["stays"]
    assert got.columns == ["ID_CLI", "RECENCY", "SPESA", "TOT_PURCHASE", "CHURN", "TYP_JOB_CLEAN", "LAST_COD_FID", "REGION"]


@pytest.fixture(scope="module")
def planted(planted_rows):
    return ch.training_tables(planted_rows)


@pytest.fixture(scope="module")
def planted_rows(spark):
    """Churn exactly when the last purchase is more than 50 days ago."""
    df = spark.range(600).select(
        F.col("id").alias(C.CUSTOMER),
        (F.col("id") * 37 % 101).cast("int").alias(C.RECENCY),
        (F.col("id") * 13 % 29).cast("decimal(18,2)").alias(C.SPEND),
        (F.col("id") % 5 + 1).alias(C.PURCHASES),
        F.element_at(F.array(*[F.lit(x) for x in ("N", "S", "W")]), (F.col("id") % 3 + 1).cast("int")).alias(C.REGION),
        F.element_at(F.array(F.lit("clerk"), F.lit("other")), (F.col("id") % 2 + 1).cast("int")).alias(C.JOB_CLEAN),
        F.lit("STANDARD").alias("_"),
    )
    df = df.withColumn(C.CARD, F.when(F.col(C.CUSTOMER) % 7 == 0, "GOLD").otherwise("STANDARD")).drop("_")
    return df.withColumn(C.CHURN, (F.col(C.RECENCY) > 50).cast("int"))


def accuracy(pred):
    return ev.metrics(pred).first()["accuracy"]


def test_encoding_base_levels(planted):
    encoder, train, _ = planted
    assert ch.term_names(encoder) == [
        C.RECENCY, C.SPEND, C.PURCHASES, "REGIONW", "REGIONS", "TYP_JOB_CLEANother", "LAST_COD_FIDSTANDARD",
    ]
    assert train.first()["features"].size == 7


def test_models_learn_a_planted_signal(spark, planted):
    encoder, train, test = planted
    tree = ch.decision_tree(train, encoder)
    found = ch.predict(tree, test)
    assert accuracy(found) > 0.95
    assert rows(found) == rows(ch.predict(ch.decision_tree(train, encoder), test))
    importance = {r["feature"]: r["importance"] for r in ch.tree_importances(tree, spark).collect()}
    assert max(importance, key=importance.get) == C.RECENCY and sum(importance.values()) == pytest.approx(1)
    assert "If" in "".join(r["rule"] for r in ch.tree_rules(tree, spark).collect())
    forest = ch.predict(ch.random_forest(train, encoder, trees=20), test)
    assert accuracy(forest) > 0.95
    assert rows(forest) == rows(ch.predict(ch.random_forest(train, encoder, trees=20), test))
    logistic = ch.predict(ch.logistic_regression(train), test)
    assert accuracy(logistic) > 0.95
    assert {r["label"] for r in found.collect()} == {"0", "1"}


def test_coefficient_table(spark):
    df = spark.range(400).select(
        F.col("id").alias(C.CUSTOMER),
        (F.col("id") * 37 % 101).cast("int").alias(C.RECENCY),
        (F.col("id") * 13 % 29).cast("decimal(18,2)").alias(C.SPEND),
        (F.col("id") % 5 + 1).alias(C.PURCHASES),
        F.when(F.col("id") % 3 == 0, "N").otherwise("S").alias(C.REGION),
        F.when(F.col("id") % 4 == 0, "clerk").otherwise("other").alias(C.JOB_CLEAN),
        F.when(F.col("id") % 7 == 0, "GOLD").otherwise("STANDARD").alias(C.CARD),
    )
    noisy = (F.col(C.RECENCY) + F.col(C.CUSTOMER) * 71 % 60 > 80).cast("int")
    encoder, train, _ = ch.training_tables(df.withColumn(C.CHURN, noisy))
    table = {r["term"]: r for r in ch.logistic_coefficients(train, encoder).collect()}
    assert set(table) == {*ch.term_names(encoder), "(Intercept)"}
    assert table[C.RECENCY]["p_value"] < 0.01 and table[C.RECENCY]["estimate"] > 0
    depths = ch.tree_complexity(train, encoder, depths=(1, 3)).collect()
    assert [r["max_depth"] for r in depths] == [1, 3] and all(0.4 < r["accuracy"] <= 1 for r in depths)
    assert 0.4 < ch.resampled_accuracy(train, folds=2).first()["accuracy"] <= 1


def test_a_category_with_one_level(planted_rows):
    one = planted_rows.withColumn(C.CARD, F.lit("ONLY"))
    encoder, train, test = ch.training_tables(one)
    assert not any(t.startswith(C.CARD) for t in ch.term_names(encoder))
    assert len(train.first()["features"]) == len(ch.term_names(encoder))
    for model in (ch.decision_tree(train, encoder), ch.logistic_regression(train)):
        assert ch.predict(model, test).count() == test.count()
    none = one.withColumns({C.REGION: F.lit("R"), C.JOB_CLEAN: F.lit("J")})
    encoder, rows_ = ch.encode(none)
    assert len(rows_.first()["features"]) == 3 and ch.term_names(encoder) == list(ch.NUMERIC)


def test_too_many_levels_raise(planted_rows):
    with pytest.raises(ValueError, match="levels"):
        ch.encode(planted_rows.withColumn(C.CARD, F.col(C.CUSTOMER).cast("string")), most_levels=100)


def test_leaves_and_fitted_totals(planted):
    encoder, train, _ = planted
    leaves = ch.leaf_shares(ch.decision_tree(train, encoder), train).collect()
    assert len(leaves) > 1 and all(x.probability == pytest.approx(x.positives / x.n) for x in leaves)
    summary = ch.logistic_summary(train).first()
    assert summary.null_deviance >= summary.residual_deviance and summary.null_df == train.count() - 1
