import hashlib
import math
from decimal import Decimal

import pytest

from retailspark.operators.split import assign_split, stratified_split


@pytest.mark.parametrize("n, p", [(1, 0.7), (10, 0.7), (30, 0.1), (1000, 0.7), (1000, 1.0), (1000, 0.0)])
def test_exact_split_equals_brute_force(spark, n, p):
    data = [(i, "1" if i % 3 == 0 else "0") for i in range(n)]
    df = spark.createDataFrame(data, "id bigint, label string")
    got = {r["id"] for r in assign_split(df, "label", "id", p, seed=5).filter("is_train").collect()}
    want = set()
    for label in "01":
        ids = [i for i, x in data if x == label]
        ids.sort(key=lambda i: (hashlib.md5(f"5|{i}".encode()).hexdigest(), str(i)))
        want |= set(ids[: math.ceil(Decimal(str(p)) * len(ids))])
    assert got == want


def test_hashed_split_and_partition(spark):
    df = spark.range(20_000).selectExpr("id", "id % 2 AS label")
    train, test = stratified_split(df, "label", "id", 0.7, seed=1, exact=False)
    assert train.count() + test.count() == 20_000
    assert abs(train.count() / 20_000 - 0.7) < 0.02
    assert train.join(test, "id").count() == 0
