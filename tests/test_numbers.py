import random

from pyspark.sql import functions as F

from baitwatch.functions.numbers import round_exact


def test_rounding_matches_python(spark):
    rng = random.Random(3)
    values = [i / 8000 for i in range(4000)] + [rng.random() for _ in range(500)] + [1234567.00005, 0.03125, 2e-9, 1.0, 0.0, 5e-5, 5e-4, 0.00015, 0.00025]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", round_exact(F.col("v"), 4).alias("a"), round_exact(F.col("v"), 3).alias("b")).collect()
    assert all(r["a"] == round(r["v"], 4) and r["b"] == round(r["v"], 3) for r in got)
    assert spark.range(1).select(round_exact(F.lit(None).cast("double"), 4)).first()[0] is None
