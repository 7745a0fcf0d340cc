import hashlib

import pytest
from pyspark.sql import functions as F

from baitwatch.operators import dataset as D
from baitwatch.operators.ordering import renumber
from baitwatch.session import spread


def key(i, seed=42):
    return hashlib.md5(f"{i}|{seed}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third-heavy class, a small one, a tiny one and NULL labels."""
    label = (F.when(F.col("mail_id") < 1400, 0).when(F.col("mail_id") < 1900, 1)
             .when(F.col("mail_id") < 1930, 2))
    return spark.range(2000).select(F.col("id").alias("mail_id"), label.alias("label"))


def test_balance_keeps_the_first_by_hash(spark, skewed):
    got = {}
    for r in D.balance_classes(skewed).collect():
        got.setdefault(r["label"], set()).add(r["mail_id"])
    assert {k: len(v) for k, v in got.items()} == {0: 30, 1: 30, 2: 30}
    assert got[0] == set(sorted(range(1400), key=key)[:30])
    assert got[2] == set(range(1900, 1930))


def test_split_is_exact_per_class(skewed):
    got = D.stratified_split(skewed, 0.2).groupBy("label").agg(
        F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect()
    assert {r["label"]: (r["t"], r["n"]) for r in got} == {0: (280, 1400), 1: (100, 500), 2: (6, 30), None: (0, 70)}


def test_folds_are_even(skewed):
    got = D.stratified_folds(skewed, 5).filter("label = 0").groupBy("fold").count().collect()
    assert {r["fold"]: r["count"] for r in got} == dict.fromkeys(range(5), 280)


def test_renumber_is_the_global_order(skewed):
    got = {r["mail_id"]: r["new_id"] for r in renumber(skewed, "mail_id").collect()}
    assert got == {i: n for n, i in enumerate(sorted(range(2000), key=key), 1)}


def test_capped_sample(skewed):
    got = {r["mail_id"] for r in D.capped_sample(skewed, 25, "mail_id").collect()}
    assert got == set(sorted(range(2000), key=key)[:25])
    assert D.capped_sample(skewed, 5000, "mail_id").count() == 2000


def test_short_bodies_ignore_any_white_space(spark):
    df = spark.createDataFrame([("\t  123456789 \n",), ("1234567890",), ("",)], "body_text string")
    assert [r[0] for r in D.drop_short_bodies(df).collect()] == ["1234567890"]


def test_thousands_of_classes(spark):
    """5,000 classes of four rows: one row per class is joined, none collected."""
    df = spark.range(20_000).select(F.col("id").alias("mail_id"), (F.col("id") % 5000).alias("label"))
    got = D.stratified_split(df, 0.25).groupBy("label").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n"))
    assert got.filter("t = 1 and n = 4").count() == 5000
    assert D.balance_classes(df).count() == 20_000


def test_plans_are_built_without_jobs(spark, skewed):
    """No Spark job runs before an action."""
    spark.sparkContext.setJobGroup("plans", "plans")
    try:
        D.balance_classes(skewed)
        D.stratified_split(skewed)
        D.stratified_folds(skewed)
        renumber(skewed, "mail_id")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    finally:
        spark.sparkContext.setJobGroup("tests", "tests")


def test_spread_moves_rows_only_where_asked(spark):
    df = spark.range(0, 100, 1, 3)
    assert spread(df).rdd.getNumPartitions() == 3
    spark.conf.set("baitwatch.input.partitions", "5")
    try:
        assert spread(df).rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset("baitwatch.input.partitions")
