import random

from pyspark.sql import functions as F

from skerry.operators import ordering


def test_numbers_are_dense_and_follow_the_order(spark):
    rng = random.Random(2)
    values = [(k, rng.choice([None, 1, 2, 3]), "x") for k in range(5000)]
    rows = spark.createDataFrame(values, "key long, v long, place string").repartition(7)
    found = ordering.numbered(rows, [F.desc_nulls_last("v"), "key"], "place", 1).collect()
    want = sorted(values, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r["key"], r["place"]) for r in sorted(found, key=lambda r: r["place"])] == [(r[0], k + 1) for k, r in enumerate(want)]


def test_no_window_and_no_single_task(spark):
    rows = spark.range(1000).select(F.col("id").alias("key"))
    plan = ordering.numbered(rows, ["key"])._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


def test_empty_and_equal_rows(spark):
    none = spark.createDataFrame([], "key long, number string")
    assert ordering.numbered(none, ["key"], "n").columns == ["key", "number", "n"]
    assert ordering.numbered(none, ["key"], "n").count() == 0
    same = spark.createDataFrame([(1,)] * 20, "key long")
    assert sorted(r["n"] for r in ordering.numbered(same, ["key"], "n").collect()) == list(range(20))
