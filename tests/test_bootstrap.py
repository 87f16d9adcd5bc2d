"""Bootstrap accuracy of given predictions."""

from math import exp, factorial

from tables import rows

from retailspark.operators.evaluation import bootstrap_accuracy, poisson_thresholds


def test_weights_are_poisson_and_repeatable(spark):
    pred = spark.range(4000).selectExpr("id", "'1' AS label", "if(id % 4 = 0, '0', '1') AS prediction")
    got = rows(bootstrap_accuracy(pred, "id"))
    assert got == rows(bootstrap_accuracy(pred.repartition(7), "id"))
    assert len(got) == 25 and len({r[2] for r in got}) > 10
    assert all(abs(n - 4000) < 400 and abs(a - 0.75) < 0.04 for _, n, a in got)
    assert all(r[1] in (None, 0) and r[2] is None for r in rows(bootstrap_accuracy(pred.limit(0), "id")))
    shares = [t / 2**32 for t in poisson_thresholds()]
    assert abs(shares[0] - exp(-1)) < 1e-9 and abs(shares[3] - shares[2] - exp(-1) / factorial(3)) < 1e-9
