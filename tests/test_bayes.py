import math

import numpy as np
import pytest
from tables import rows

from retailspark.operators import bayes as nb
from retailspark.operators import evaluation as ev


def brute(train, test, floor=0.001):
    out = {}
    for key, _, x, g in test:
        score = {}
        for c in ("0", "1"):
            mine = [r for r in train if r[1] == c]
            values = np.array([r[2] for r in mine])
            sd = values.std(ddof=1) or floor
            density = math.exp(-0.5 * ((x - values.mean()) / sd) ** 2) / (sd * math.sqrt(2 * math.pi)) or floor
            share = sum(r[3] == g for r in mine) / len(mine) or floor
            score[c] = math.log(len(mine) / len(train)) + math.log(density) + math.log(share)
        best = max(score.values())
        weight = {c: math.exp(s - best) for c, s in score.items()}
        out[key] = ("1" if score["1"] > score["0"] else "0", weight["1"] / sum(weight.values()))
    return out


def make(seed, n):
    rng = np.random.default_rng(seed)
    return [
        (i, str(int(c)), float(rng.normal(3 * c, 1)), str(rng.choice(["a", "b", "c"], p=[0.2, 0.3, 0.5] if c else [0.6, 0.4, 0])))
        for i, c in enumerate(rng.integers(0, 2, n))
    ]


SCHEMA = "id bigint, churn string, x double, g string"


def test_equals_brute_force(spark):
    train, test = make(1, 200), [*make(2, 60), (900, "1", 0.5, "new"), (901, "0", 1e6, "c")]
    model = nb.fit_bayes(spark.createDataFrame(train, SCHEMA), "churn", ["x"], ["g"])
    got = {r["id"]: r for r in nb.predict_bayes(model, spark.createDataFrame(test, SCHEMA), "id").collect()}
    for key, (prediction, probability) in brute(train, test).items():
        assert got[key]["prediction"] == prediction
        assert got[key]["probability"] == pytest.approx(probability, abs=1e-9)


def test_no_spread_and_missing_predictors(spark):
    train = [(1, "0", 5.0, "a"), (2, "0", 5.0, "a"), (3, "1", 7.0, "b"), (4, "1", 7.0, None)]
    test = [(10, "0", 5.0, "a"), (11, "1", 7.0, "b"), (12, "1", None, None)]
    model = nb.fit_bayes(spark.createDataFrame(train, SCHEMA), "churn", ["x"], ["g"])
    got = {r["id"]: r for r in nb.predict_bayes(model, spark.createDataFrame(test, SCHEMA), "id").collect()}
    assert (got[10]["prediction"], got[11]["prediction"]) == ("0", "1")
    assert got[12]["probability"] == pytest.approx(0.5)
    shares = {(r["class"], r["level"]): r["value"] for r in model.parameters().filter("feature = 'g'").collect()}
    assert shares == {("0", "a"): 1.0, ("0", "b"): 0.0, ("1", "a"): 0.0, ("1", "b"): 1.0}


def test_measures_by_hand(spark):
    cells = [("1", "1", 40), ("0", "1", 20), ("1", "0", 10), ("0", "0", 30)]
    pred = spark.createDataFrame([(a, b) for a, b, n in cells for _ in range(n)], "label string, prediction string")
    assert rows(ev.confusion(pred)) == sorted(((a, b, n) for a, b, n in cells), key=repr)
    m = ev.metrics(pred).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (40, 20, 10, 30)
    assert m.accuracy == 0.7 and m.recall == 0.8 and m.specificity == 0.6 and m.precision == pytest.approx(2 / 3)
    assert m.kappa == pytest.approx((0.7 - 0.5) / 0.5) and m.no_information_rate == 0.5
    assert m.f1 == pytest.approx(80 / 110)
    swapped = pred.selectExpr("prediction AS label", "label AS prediction")
    assert ev.f1(swapped).first()[0] == ev.f1(pred).first()[0]
    both = {r["model"]: r["accuracy"] for r in ev.compare_models({"a": pred, "b": swapped}).collect()}
    assert both == {"a": 0.7, "b": 0.7}


def test_measures_without_positives(spark):
    pred = spark.createDataFrame([("0", "0")], "label string, prediction string")
    m = ev.metrics(pred).first()
    assert m.accuracy == 1.0 and m.recall is None and m.f1 is None
