from tables import rows

from retailspark.operators import joins as jn


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_flag_members_keeps_every_row_once(spark):
    people = frame(spark, [(1,), (2,), (None,)], "id int")
    seen = frame(spark, [(1,), (1,), (None,)], "id int")
    assert rows(jn.flag_members(people, seen, "id", "churn")) == [(1, 0), (2, 1), (None, 1)]


def test_enrich_does_not_multiply_rows(spark):
    people = frame(spark, [(1,), (2,), (3,)], "id int")
    dim = frame(spark, [(1, "b", "x"), (1, "a", "y"), (1, None, "a"), (2, None, "z")], "id int, job string, card string")
    assert rows(jn.enrich(people, dim, "id", ["job", "card"])) == [(1, "a", "y"), (2, None, "z"), (3, None, None)]
    assert jn.enrich(people, dim, "id", ["job"], unique=False).count() == 5


def test_enrich_via(spark):
    people = frame(spark, [(1,), (2,), (3,)], "id int")
    bridge = frame(spark, [(1, "A", "j1"), (2, None, "j2")], "id int, addr string, job string")
    dim = frame(spark, [("A", "North"), ("B", "South")], "addr string, region string")
    got = jn.enrich_via(people, bridge, dim, "id", "addr", ["region"], ["job"])
    assert got.columns == ["id", "job", "region"]
    assert rows(got) == [(1, "j1", "North"), (2, "j2", None), (3, None, None)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return plan(df)


SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


def test_hot_keys_are_split(spark):
    """A third of the rows on one key: every join splits that key's partition over several tasks."""
    hot = "CASE WHEN id % 3 = 0 THEN 7 ELSE id END"
    left = spark.range(0, 60_000, 1, 8).selectExpr(f"{hot} AS ID_CLI", f"{hot} AS ID_ADDRESS", "uuid() AS x")
    people = spark.range(0, 60_000, 1, 8).selectExpr("id AS ID_CLI", "id % 100 AS REGION")
    places = people.selectExpr("ID_CLI AS ID_ADDRESS", "REGION")
    for key, value in SKEW.items():
        spark.conf.set(key, value)
    try:
        for joined in (
            jn.restrict_to(left, people.groupBy("ID_CLI").count()),
            jn.flag_members(left, people),
            jn.enrich(left, people, "ID_CLI", ["REGION"]),
            jn.enrich(left, places, "ID_ADDRESS", ["REGION"]),
        ):
            assert "skew=true" in final_plan(joined)
    finally:
        for key in SKEW:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_text_keys_are_hashed_not_sorted(spark):
    """Identifiers of the data model are texts; no aggregate over them may need a sort."""
    people = frame(spark, [("1", "x"), ("2", "y")], "ID_CLI string, REGION string")
    seen = frame(spark, [("1",), ("1",)], "ID_CLI string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for joined in (
            jn.restrict_to(people, seen),
            jn.flag_members(people, seen),
            jn.enrich(people, people.withColumnRenamed("REGION", "R"), "ID_CLI", ["R"]),
        ):
            assert "SortAggregate" not in plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
