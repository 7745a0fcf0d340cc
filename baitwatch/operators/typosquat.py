"""Look-alike domains against a registry of any size.

Two words within two edits of each other have a string in common after deleting up to
two letters from either. So both sides are listed with all such strings (their deletion
neighbourhood), meet in one hash join on them, and the exact distance decides. No pair
is compared that shares no such string, and nothing is cross joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx


def _without_one(word: Column) -> Column:
    """Every string that ``word`` leaves after one letter is deleted."""
    places = F.when(F.length(word) > 0, F.sequence(F.lit(1), F.length(word))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.left(word, i - 1), F.substring(word, i + 1, F.length(word))))


def neighbourhood(word: Column, distance: int) -> Column:
    """``word`` and all strings left after deleting up to ``distance`` letters of it."""
    found = level = F.array(word)
    for _ in range(distance):
        level = F.array_distinct(F.flatten(F.transform(level, _without_one)))
        found = F.concat(found, level)
    return F.array_distinct(found)


def near_pairs(words: DataFrame, brands: DataFrame, max_distance: int = lx.TYPOSQUAT_MAX_DISTANCE) -> DataFrame:
    """``word, brand`` of every pair within ``max_distance`` edits, equal ones included.
    Words are ``words.word`` and ``brands.brand``, distinct; empty ones and nulls meet
    nothing."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(name) != "").select(name, F.explode(neighbourhood(F.col(name), max_distance)).alias("_left"))

    # A word much longer or shorter than all brands is near none; it isn't listed.
    span = brands.where("brand <> ''").agg(F.min(F.length("brand")).alias("a"), F.max(F.length("brand")).alias("b"))
    fit = words.join(F.broadcast(span), F.length("word").between(F.col("a") - max_distance, F.col("b") + max_distance)).select("word")
    met = listed(fit, "word").join(listed(brands, "brand"), "_left").select("word", "brand").distinct()
    return met.where(F.levenshtein("word", "brand", max_distance) >= 0)


def flag_lookalikes(domains: DataFrame, registry: DataFrame, max_distance: int = lx.TYPOSQUAT_MAX_DISTANCE,
                    domain_col: str = "full_domain", registry_col: str = "domain") -> DataFrame:
    """``domains`` with ``is_typosquat``: the first label, or a part of it between hyphens,
    equals or comes within ``max_distance`` edits of the first label of a registered
    domain that is not the whole label itself. Labels are compared once each, however
    often they occur; a null domain is no look-alike, an empty registry flags nothing.

    A word is near few or many brands; all that matters later is whether one of them
    differs from the label, so the least and the greatest of them are kept."""
    label = F.substring_index(F.col(domain_col), ".", 1)
    labels = domains.select(label.alias("_label")).where("_label is not null").distinct()
    parts = labels.select("_label", F.explode(F.array_distinct(F.array_append(F.split("_label", "-", -1), F.col("_label")))).alias("word"))
    brands = registry.select(F.substring_index(F.col(registry_col), ".", 1).alias("brand")).distinct()
    hits = near_pairs(parts.select("word").distinct(), brands, max_distance).groupBy("word").agg(
        F.min("brand").alias("_low"), F.max("brand").alias("_high"))
    flagged = parts.join(hits, "word").where((F.col("_low") != F.col("_label")) | (F.col("_high") != F.col("_label"))).select(
        F.col("_label").alias("_flagged")).distinct()
    return domains.join(flagged, label == F.col("_flagged"), "left").withColumn("is_typosquat", F.col("_flagged").isNotNull()).drop("_flagged")
