"""Mixing sources to target weights by Pareto order sampling: whole copies are given
first, then documents are taken in the order of random odds over inclusion odds
until their source's remaining words are met."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baitwatch.llm.common import SEPARATORS, SEPARATOR_RUN, stage

# Fixed number of bins of the sampling order in which words are added up first.
BINS = 4096
SALTS = 64
# Digits of the md5 that make the uniform number (13 hexadecimal digits: 52 bits).
UNIFORM_DIGITS = 13


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, SEPARATOR_RUN))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
                   max_repeat: int = 2) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``. Sources in code
    point order (null last) take ``weights`` in turn. Of ``share`` times all words each
    gets its weight's part, but ``max_repeat`` times its own words at most, the rest
    being shared again. That is ``least(max_repeat * size, level * weight)``: with the
    sources in the order of ``size / weight``, the level is the first at which all
    sources capped so far stay capped. One row per source passes here, no documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (k + 1).cast("int")))
    by_cap = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    at = weighted.withColumns({
        "_capped": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_repeat,
        "_left_w": F.sum("_w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
        "_all": F.sum("source_size").over(all_rows)})
    at = at.withColumn("_level", (F.col("_all") * F.lit(share) - F.col("_capped")) / F.col("_left_w"))
    holds = F.col("_level") * F.col("_w") <= F.col("source_size") * max_repeat
    level = F.min(F.when(holds, F.struct(F.col("source_size") / F.col("_w"), F.col("_level").alias("level")))).over(all_rows)
    return at.withColumn("_found", level["level"]).select(
        "source", "source_size",
        F.when(F.col("_found").isNull(), F.col("source_size") * F.lit(float(max_repeat)))
        .otherwise(F.least(F.col("source_size") * F.lit(float(max_repeat)), F.col("_found") * F.col("_w"))).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_repeat: int = 2,
         seed: int = 23) -> DataFrame:
    """``row`` (the input as it is), ``size``, ``source_size``, ``target``, ``copies``,
    ``taken``. Every document gets ``floor(target / source_size)`` whole copies. One
    more goes to documents in the order of ``u / (1 - u)`` over their inclusion odds,
    where longer documents have higher odds (``size / (size + 200)`` times those of
    the source), up to the place where the source's words are nearest to the target:
    off by half a document at most. ``u`` comes from the md5 of doc_id and seed, so
    reruns agree; rows of one doc_id go by size and checksum, equal rows all share one
    place and are taken together. Empty texts have no words and get no extra copy."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), n_words(F.col("text")).alias("size"))
    return allot(rows, F.col("row.doc_id"), F.col("row.source"), weights, share, max_repeat, seed)


def allot(rows: DataFrame, doc_id: Column, source: Column, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
          max_repeat: int = 2, seed: int = 23) -> DataFrame:
    """The plan for rows that already have their ``size``. The limits of each source
    come from narrow columns written once; rows meet them in a join on the source,
    whose other side has one row per source."""
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"|{seed}"))), 1, UNIFORM_DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16 ** UNIFORM_DIGITS))
    odds = F.col("size") / (F.col("size") + F.lit(200.0))
    keyed = rows.withColumn("_src", source).withColumn("_q", F.when(F.col("size") > 0, u / (F.lit(1.0) - u) / odds))
    # The order variable mapped to (0, 1) for its bin; bins ascend with it.
    keyed = keyed.withColumn("_bin", F.floor(F.col("_q") / (F.lit(1.0) + F.col("_q")) * BINS).cast("int"))
    light = stage(keyed.select("_src", "size", "_q", "_bin"), "mix")
    sizes = light.groupBy(F.col("_src").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, max_repeat).select(
        F.col("source").alias("_ts"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("_whole"))
    targets = targets.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    # Words per bin: the crossing bin of each source is the one that holds its cut.
    bins = light.where("_q is not null").groupBy("_src", "_bin").agg(F.sum("size").alias("_words"))
    run = Window.partitionBy("_src").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_words").over(run), F.lit(0)))
    crossing = bins.join(targets, F.col("_src").eqNullSafe(F.col("_ts"))).where(
        (F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_words") >= F.col("_rest"))).select(
        F.col("_src").alias("_cs"), F.col("_bin").alias("_cb"), "_before", "_rest")
    # Inside that bin alone, words by order; the cut is where they come nearest.
    inside = light.join(
        crossing, F.col("_src").eqNullSafe(F.col("_cs")) & (F.col("_bin") == F.col("_cb"))).groupBy(
        "_src", "_q", "_before", "_rest").agg(F.sum("size").alias("_words"))
    upto = Window.partitionBy("_src").orderBy("_q").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_sum", F.col("_before") + F.sum("_words").over(upto))
    taken = inside.where(F.col("_sum") - F.col("_rest") <= F.col("_rest") - (F.col("_sum") - F.col("_words")))
    cut = taken.groupBy(F.col("_src").alias("_us")).agg(F.max("_q").alias("_cut"))
    cuts = crossing.join(cut, F.col("_cs").eqNullSafe(F.col("_us")), "left").select("_cs", "_cb", "_cut")
    limits = targets.join(cuts, F.col("_ts").eqNullSafe(F.col("_cs")), "left").select(
        "_ts", "source_size", "target", "_whole", F.col("_cb"), "_cut")
    # A source's rows are dealt over SALTS keys, so none meets its limits in one task.
    limits = limits.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = keyed.withColumn("_salt", F.pmod(F.xxhash64(doc_id, F.col("size"), F.col("_q")), F.lit(SALTS)).cast("int"))
    chosen = dealt.join(limits, F.col("_src").eqNullSafe(F.col("_ts")) & (F.col("_salt") == F.col("_part")))
    extra = F.coalesce((F.col("_bin") < F.col("_cb")) | (F.col("_q") <= F.col("_cut")), F.lit(False)).cast("long")
    copies = F.col("_whole") + extra
    return chosen.select(*rows.columns, "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row as often as its copies, columns as in the input."""
    return plan(docs, **how).where("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
