"""Tables with one URL per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U


def explode_urls(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """``(id, pos, url)`` rows; texts without a link give none."""
    return df.select(id_col, F.posexplode(U.find_urls(F.col(text_col))).alias("pos", "url"))


def aggregate_url_rows(features: DataFrame, key: str) -> DataFrame:
    """Per-owner summary of ``with_url_features`` rows. Count, max and any
    combine on the map side, so an owner with very many links stays cheap."""
    return features.groupBy(key).agg(
        F.count(F.lit(1)).cast("int").alias("num_urls"),
        *[F.max(n).alias(n) for n in U.NUMERIC_FEATURES],
        *[F.bool_or(n).alias(n) for n in U.BOOLEAN_FEATURES],
        F.bool_and("has_https").alias("has_https"),
    )
