import pytest
from pyspark.sql import functions as F

from millrace.operators import skew


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(3000).select(F.col("id").alias("n"), F.when(
        F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("string").alias("k"))
    left = left.unionByName(spark.createDataFrame([(9000, None)], "n long, k string"))
    right = spark.range(0, 40, 2).select(F.col("id").cast("string").alias("k"),
                                         (F.col("id") * 10).alias("v"))
    hot = skew.hot_keys(left, ["k"], 200)
    assert [tuple(r) for r in hot.collect()] == [("0", 6)]
    got = skew.salted_join(left, right, ["k"], how, ["n"], hot_rows=200)
    want = left.join(right, ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_key_is_spread_over_its_salts(spark):
    left = spark.range(1000).select(F.col("id").alias("n"), F.lit("x").alias("k"))
    salts = skew.hot_keys(left, ["k"], 100).first()["salts"]
    used = left.select(F.pmod(F.xxhash64("n"), F.lit(salts)).alias("s")).groupBy("s").count().collect()
    assert len(used) == 10 and max(r["count"] for r in used) < 200


def test_other_kinds_are_refused(spark):
    with pytest.raises(ValueError):
        skew.salted_join(spark.range(1), spark.range(1), ["id"], "full", ["id"])
