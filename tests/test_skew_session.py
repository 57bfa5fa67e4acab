"""Salted joins and scratch tables."""

import os

from pyspark.sql import functions as F

from frameloom.operators import skew
from frameloom.session import Scratch, release


def test_salted_join_equals_the_plain_one(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None).cast("string")).otherwise(F.col("id").cast("string")).alias("k"))
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("5", 3), (None, 4)], "k string, x int")
    want = sorted(map(tuple, rows.join(other, "k", "left").select("id", "k", "x").collect()))
    for hot in (None, skew.hot_of(rows.groupBy("k").count(), "k", "count", 5000)):
        mine, theirs = skew.salted(rows, other, "k", F.col("id"), 5000, hot)
        assert sorted(map(tuple, mine.join(theirs, ["k", "_salt"], "left").select("id", "k", "x").collect())) == want
        assert mine.where("k = 'hot'").select("_salt").distinct().count() == skew.SALTS and mine.where("k <> 'hot' or k is null").select("_salt").distinct().count() == 1


def test_hot_keys_are_few_whatever_the_rows(spark):
    rows = spark.range(20_000).select((F.col("id") % 700).alias("k"))
    assert skew.hot_keys(rows, "k", 20_000).count() == 700 and skew.hot_keys(rows.withColumn("k", F.col("k") + F.floor(F.rand(1) * 5) * 1000), "k", 20_000).count() < skew.HOT


def test_scratch_counts_drops_and_is_released(spark):
    scratch = Scratch(spark, "test")
    made, n = scratch.write_counted(spark.range(10), "ten", even=F.count_if(F.col("id") % 2 == 0))
    assert n == {"n": 10, "even": 5} and made.count() == 10
    assert scratch.write_counted(spark.range(10).where("id > 50"), "none")[1] == {"n": 0}
    scratch.drop("none")
    assert os.path.exists(scratch.path("ten")) and not os.path.exists(scratch.path("none"))
    release(spark)
    assert not os.path.exists(scratch.root)
