"""Media operators over frame, box, clip and unit-score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.numbers import round_exact
from ..functions.scoring import decision, risk_tier
from ..session import ensure_checkpoint_dir

# Size of the quantile sketches, and the ranks at which they give bounds: so far from the
# middle on either side.
SKETCH_K = 1024
MIDDLE = (0.2, 0.05, 0.01)


def sample_frames(frames: DataFrame, every: int = lx.FRAME_STEP) -> DataFrame:
    return frames.filter(F.pmod("frame_index", F.lit(every)) == 0)


def crop_boxes(boxes: DataFrame, padding: float = lx.CROP_PADDING) -> DataFrame:
    """Corner boxes -> whole-pixel boxes -> padded, clamped crops; empty crops
    are dropped."""
    whole = boxes.withColumns({
        "x": F.col("x1").cast("int"), "y": F.col("y1").cast("int"),
        "w": (F.col("x2") - F.col("x1")).cast("int"), "h": (F.col("y2") - F.col("y1")).cast("int"),
    })
    pad_x = (F.col("w") * F.lit(padding)).cast("int")
    pad_y = (F.col("h") * F.lit(padding)).cast("int")
    cropped = whole.withColumns({
        "crop_x1": F.greatest(F.lit(0), F.col("x") - pad_x),
        "crop_y1": F.greatest(F.lit(0), F.col("y") - pad_y),
        "crop_x2": F.least(F.col("frame_width"), F.col("x") + F.col("w") + pad_x),
        "crop_y2": F.least(F.col("frame_height"), F.col("y") + F.col("h") + pad_y),
    })
    return cropped.filter((F.col("crop_x2") > F.col("crop_x1")) & (F.col("crop_y2") > F.col("crop_y1")))


def audio_segments(clips: DataFrame, sample_rate: int = lx.SAMPLE_RATE,
                   seconds: int = lx.SEGMENT_SECONDS) -> DataFrame:
    """Fixed-length segments; a short clip is one, the last one is kept, an
    empty clip gives none."""
    step, total = F.lit(sample_rate * seconds).cast("bigint"), F.col("total_samples")
    starts = F.when(total > 0, F.sequence(F.lit(0).cast("bigint"), total - 1, step))
    return (clips.select("*", F.posexplode(starts).alias("segment_no", "start_sample"))
            .withColumn("end_sample", F.least(F.col("start_sample") + step, total))
            .withColumn("n_samples", F.col("end_sample") - F.col("start_sample")))


def unit_label(entries: Column) -> Column:
    """Label with the highest probability; the first one wins a tie.
    ``entries`` is ARRAY<STRUCT<label, p>>."""
    best = F.aggregate(entries, F.get(entries, F.lit(0)), lambda acc, e: F.when(e["p"] > acc["p"], e).otherwise(acc))
    return best["label"]


def unit_fake_probability(entries: Column) -> Column:
    """Score of the first known fake label, else of the second class."""
    by_label = F.map_from_entries(entries)
    second = F.coalesce(F.get(entries, F.lit(1)), F.get(entries, F.lit(0)))["p"]
    return F.coalesce(*[F.try_element_at(by_label, F.lit(k)) for k in lx.FAKE_LABEL_KEYS], second)


def median_bounds(units: DataFrame, group: str, value: str) -> DataFrame:
    """``(_g, n_units, _b)``: values near the middle of each group, ascending, from a
    quantile sketch that is combined on the map side. Sketches are random in part, so the
    bounds are written to the checkpoint folder: whoever reads them sees the same ones."""
    present = units.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(
        F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    ensure_checkpoint_dir(units.sparkSession)
    sketched = present.groupBy("_g").agg(F.count(F.lit(1)).alias("n_units"), F.kll_sketch_agg_double("_v", F.lit(SKETCH_K)).alias("_s"))
    ranks = sorted(0.5 + sign * d for d in MIDDLE for sign in (-1, 1))
    return sketched.select("_g", "n_units", F.array(*[F.kll_sketch_get_quantile_double("_s", F.lit(r)) for r in ranks]).alias("_b")).checkpoint()


def in_zones(units: DataFrame, group: str, value: str, bounds: DataFrame) -> DataFrame:
    """``(_g, n_units, _v, _zone)``: between which bounds each value lies; equal values
    share a zone, zones ascend with the values."""
    present = units.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(
        F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    zone = sum((F.col("_v") > F.get("_b", F.lit(i))).cast("int") for i in range(2 * len(MIDDLE)))
    return present.join(bounds, "_g").select("_g", "n_units", "_v", zone.alias("_zone"))


def exact_medians(units: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, median, n_units)``, exact for groups of any size and shape, on one path:
    a sketch gives bounds near the middle, exact counts between the bounds (combined on
    the map side) tell in which zones the middle ordinals lie, and only rows of these
    are collapsed to distinct values and ranked: about a fiftieth of a large group,
    wherever its outliers are. Bounds decide what is ranked, never the result. Missing
    and NaN values take no part."""
    binned = in_zones(units, group, value, median_bounds(units, group, value))
    counts = binned.groupBy("_g", "_zone", "n_units").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_g").orderBy("_zone"))
    first, second = F.floor((F.col("n_units") + 1) / 2), F.floor(F.col("n_units") / 2) + 1
    placed = counts.withColumn("_before", upto - F.col("_c"))

    def inside(at: Column, before: str, n: str) -> Column:
        return (at > F.col(before)) & (at <= F.col(before) + F.col(n))

    middle = placed.filter(inside(first, "_before", "_c") | inside(second, "_before", "_c")).select("_g", "_zone", "_before")
    values = binned.join(middle, ["_g", "_zone"]).groupBy("_g", "_zone", "_before", "n_units", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = values.withColumn("_at", F.col("_before") - F.col("_c") + F.sum("_c").over(
        Window.partitionBy("_g", "_zone").orderBy("_v")))
    return ranked.groupBy("_g", "n_units").agg(
        ((F.max(F.when(inside(first, "_at", "_c"), F.col("_v"))) + F.max(F.when(inside(second, "_at", "_c"), F.col("_v")))) / 2).alias("median")
    ).select(F.col("_g").alias(group), "median", "n_units")


def media_verdicts(media: DataFrame, units: DataFrame, channel: str) -> DataFrame:
    """One verdict per medium: median of its unit scores, tier, decision. Unit
    scores stay a table of their own instead of a list inside the verdict."""
    empty_tier = {"video": "NO_FACE_DETECTED", "audio": "NO_AUDIO_DETECTED"}[channel]
    positive = {"video": "deepfake", "audio": "synthetic"}[channel]
    medians = exact_medians(units, "media_id", "fake_probability")
    out = media.join(medians, "media_id", "left")
    none, m = F.col("n_units").isNull(), F.col("median")
    return out.withColumns({
        "fake_probability": F.coalesce(round_exact(m, 4), F.lit(0.0)),
        "risk_tier": F.when(none, F.lit(empty_tier)).otherwise(risk_tier(m, lx.TOP_TIER[channel])),
        "prediction": F.when(none, F.lit("unable_to_assess")).otherwise(decision(m, positive, "authentic")),
        "num_units_analyzed": F.coalesce("n_units", F.lit(0)),
    }).drop("median", "n_units")
