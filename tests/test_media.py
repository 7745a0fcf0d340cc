import random
import statistics

import pytest
from pyspark.sql import functions as F

from baitwatch.operators import media as M
from baitwatch.operators.learn import evaluate


def test_segments(spark):
    df = spark.createDataFrame([(1, 160000), (2, 32000), (3, 0), (4, 64000)], "media_id int, total_samples long")
    got = {}
    for r in M.audio_segments(df).orderBy("media_id", "segment_no").collect():
        got.setdefault(r["media_id"], []).append(r["n_samples"])
    assert got == {1: [64000, 64000, 32000], 2: [32000], 4: [64000]}


def test_frame_sampling(spark):
    df = spark.range(40).select(F.col("id").alias("frame_index"))
    assert [r[0] for r in M.sample_frames(df).collect()] == [0, 15, 30]


def test_crops_are_padded_clamped_and_never_empty(spark):
    df = spark.createDataFrame([
        (100.9, 50.2, 200.1, 150.8, 640, 480), (-5.0, -5.0, 30.0, 30.0, 640, 480), (700.0, 10.0, 720.0, 20.0, 640, 480),
    ], "x1 double, y1 double, x2 double, y2 double, frame_width int, frame_height int")
    got = [tuple(r) for r in M.crop_boxes(df).select("x", "y", "w", "h", "crop_x1", "crop_y1", "crop_x2", "crop_y2").collect()]
    assert got == [(100, 50, 99, 100, 81, 30, 218, 170), (-5, -5, 35, 35, 0, 0, 37, 37)]


def test_unit_score_from_probabilities(spark):
    cases = [([("real", 0.3), ("fake", 0.7)], "fake", 0.7), ([("Spoof", 0.2), ("bona", 0.8)], "bona", 0.2),
             ([("A", 0.5), ("B", 0.5)], "A", 0.5), ([("1", 0.9), ("0", 0.1)], "1", 0.9)]
    df = spark.createDataFrame([(c[0],) for c in cases], "e array<struct<label:string,p:double>>")
    got = df.select(M.unit_label(F.col("e")).alias("l"), M.unit_fake_probability(F.col("e")).alias("f")).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


@pytest.fixture
def units(spark):
    rng = random.Random(5)
    rows = [(1, rng.random()) for _ in range(4001)] + [(2, rng.choice([0.1, 0.9])) for _ in range(3000)]
    rows += [(3, 0.5)] * 2500 + [(4, rng.random() ** 8) for _ in range(2000)] + [(5, 0.868), (5, 0.773)]
    return rows, spark.createDataFrame(rows, "media_id int, fake_probability double").repartition(8)


def test_medians_are_exact_for_any_group_size(units):
    rows, df = units
    got = {r["media_id"]: (r["median"], r["n_units"]) for r in M.exact_medians(df, "media_id", "fake_probability").collect()}
    for m in range(1, 6):
        scores = [s for k, s in rows if k == m]
        assert got[m] == (pytest.approx(statistics.median(scores), abs=1e-15), len(scores))


def test_median_of_a_group_of_many_units(spark):
    df = spark.range(300_001).select(F.lit(1).alias("m"), (F.col("id") * F.col("id")).cast("double").alias("v"))
    assert tuple(M.exact_medians(df, "m", "v").first()) == (1, 150_000.0 ** 2, 300_001)


def test_an_outlier_puts_no_large_group_into_one_zone(spark):
    """Half a million values near 0 and one at 1: value ranges of equal width would hold
    them all in one; the zones that are ranked stay small."""
    df = spark.range(500_001).select(F.lit(1).alias("m"), F.when(F.col("id") == 0, 1.0).otherwise(F.col("id") * 1e-12).alias("v"))
    zones = {r["_zone"]: r["n"] for r in M.in_zones(df, "m", "v", M.median_bounds(df, "m", "v")).groupBy("_zone").agg(F.count("*").alias("n")).collect()}
    assert zones[len(M.MIDDLE)] < 25_000 and len(zones) == 2 * len(M.MIDDLE) + 1
    assert tuple(M.exact_medians(df, "m", "v").first()) == (1, 250_001 * 1e-12, 500_001)


def test_nan_scores_are_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 0.2), (2, float("nan"))], "media_id int, fake_probability double")
    got = {r["media_id"]: r for r in M.media_verdicts(spark.createDataFrame([(1,), (2,)], "media_id int"), df, "video").collect()}
    assert got[1]["fake_probability"] == 0.2 and got[2]["prediction"] == "unable_to_assess"


def test_verdicts(spark, units):
    media = spark.createDataFrame([(5,), (3,), (99,)], "media_id int")
    got = {r["media_id"]: r for r in M.media_verdicts(media, units[1], "audio").collect()}
    assert (got[5]["fake_probability"], got[5]["risk_tier"], got[5]["prediction"]) == (0.8205, "SYNTHETIC", "synthetic")
    assert (got[3]["risk_tier"], got[3]["prediction"]) == ("SUSPICIOUS", "synthetic")
    assert (got[99]["risk_tier"], got[99]["prediction"], got[99]["num_units_analyzed"]) == (
        "NO_AUDIO_DETECTED", "unable_to_assess", 0)


def test_one_outlier_does_not_move_a_verdict(spark):
    df = spark.createDataFrame([(1, 0.999995)] + [(1, 0.001 * i) for i in range(14)], "media_id int, fake_probability double")
    row = M.media_verdicts(spark.createDataFrame([(1,)], "media_id int"), df, "video").first()
    assert row["risk_tier"] == "SAFE" and row["prediction"] == "authentic"


def test_metrics_without_positives_are_zero(spark):
    row = evaluate(spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (1.0, 0.0, 0.0, 0.0)
