"""Proportional stratified interleaving: rows of every source, shuffled by a seed, get
evenly spaced fractional ranks; the order of these ranks is cut into shards, so each
shard holds the mixture of the whole and the counts differ by one at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from baitwatch.llm.common import stage


def _rank_in_bins(rows: DataFrame, keys: list[str], bin_: Column, order: list[str], out: str) -> DataFrame:
    """Rank (from 0) of each row under ``order`` within ``keys`` without sorting a key
    in one task: counts per bin give each bin's first rank, rows are numbered inside
    their bin. Bins must ascend with ``order``."""
    binned = rows.withColumn("_bin", bin_)
    counts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bin").alias("_b"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(*order)
    same = F.col("_bin") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    numbered = binned.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(first, same).withColumn(out, F.col("_first") + F.col("_at")).select(*rows.columns, out)


def shard(docs: DataFrame, n_shards: int, seed: int = 17) -> DataFrame:
    """``doc_id, source, size, text_crc32, shard, slot`` for every row. A null source
    is a source of its own, a null text an empty one. Rows of one doc_id are ordered
    by size and checksum; equal rows get the places of that order in turn. Needs the
    columns ``doc_id, text, source``; others are ignored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}")))
    hashed = stage(rows.withColumn("_h", digest), "shard")
    ties = ["_h", "doc_id", "size", "text_crc32"]
    prefix = F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    in_source = _rank_in_bins(hashed, ["source"], prefix, ties, "_rank")
    totals = hashed.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("_total"))
    placed = in_source.join(totals, F.col("source").eqNullSafe(F.col("_s"))).withColumn(
        "_f", (F.col("_rank") + F.lit(0.5)) / F.col("_total")).withColumn("_rows", hashed.agg(F.count("*").alias("n")).scalar())
    # Ranges of the whole order; null sources sort first. Many small sources share a
    # fraction (one half, where each has one row), so the fraction alone cuts no bins.
    order = ["_f", "source", *ties]
    parts = stage(placed.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "parts")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n")).select(
        "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    ranked = parts.withColumn("_at", at).join(first, F.col("_part") == F.col("_p")).withColumn("_pos", F.col("_first") + F.col("_at"))
    cut = ranked.withColumn("shard", F.floor(F.col("_pos") * n_shards / F.col("_rows")).cast("int"))
    begin = F.expr(f"(shard * _rows + {n_shards - 1}) div {n_shards}")
    return cut.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("_pos") - begin).cast("long").alias("slot"))
