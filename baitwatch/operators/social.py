"""Post scan: text, account and image signals fused into one row; narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import social as S
from ..functions.lexicons import TOP_TIER
from ..functions.numbers import round_exact
from ..functions.scoring import risk_tier
from ..functions.strings import flag
from ..functions.text import TEXT_FEATURES
from .features import with_text_features


def with_behaviour(df: DataFrame, as_of: Column) -> DataFrame:
    df = df.withColumns(S.behaviour_stage(as_of)(F.col))
    return df.withColumns(S.red_flag_stage(F.col))


def scan_posts(posts: DataFrame, as_of: Column, keep: tuple[str, ...] = ("post_id",),
               features: bool = True) -> DataFrame:
    """Scores and tier of each post, with the features behind them unless left out."""
    # Without the features only those behind the text risk are computed.
    names = TEXT_FEATURES if features else S.TEXT_RISK_FEATURES
    df = with_behaviour(with_text_features(posts, "post_text", names), as_of)
    df = df.withColumns({"_text": S.text_risk(F.col),
                         "_account": S.behaviour_risk(F.col("behavioral_red_flag_count"))})
    df = df.withColumn("_fused", S.fused_score(
        F.col("_text"), F.col("_account"), F.col("image_fake_probability"), F.col("image_applicable")))
    image = F.when(flag(F.col("image_applicable")), F.coalesce("image_fake_probability", F.lit(0.0))).otherwise(F.lit(0.0))
    return df.select(
        *keep,
        round_exact(F.col("_fused"), 4).alias("fused_risk_score"),
        risk_tier(F.col("_fused"), TOP_TIER["social"]).alias("risk_tier"),
        round_exact(F.col("_text"), 4).alias("text_risk_score"),
        F.when(F.col("image_applicable").isNotNull(), round_exact(image, 4)).alias("image_risk_score"),
        "image_applicable",
        round_exact(F.col("_account"), 4).alias("behavioral_risk_score"),
        *([F.struct(*TEXT_FEATURES).alias("text_features"), F.struct(*S.BEHAVIOUR_FEATURES).alias("behavioral_features")]
          if features else []),
    )
