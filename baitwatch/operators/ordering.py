"""Seeded random order without a global sort.

The order of rows is the order of ``md5(id|seed)``. A hex prefix of the hash
cuts the rows into even buckets, so ordinals come from small bucket counts plus
a rank inside one bucket; no task ever holds a whole class or the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hexadecimal digits of the hash that make a bucket: 65,536 of them, at any size.
DIGITS = 4


def order_key(id_col: str, seed: int = 42) -> Column:
    """Hash that defines the order; ``id_col`` must be unique."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def class_cutoffs(df: DataFrame, class_col: str, id_col: str, seed: int,
                  ordinals: Callable[[Column, Column], list[Column]]) -> DataFrame:
    """``(cls, at)``: for each class the order keys found at the wanted ordinals.

    ``ordinals(class_size, smallest_class)`` gives the wanted positions (0 means
    before the first row, and a null key). Only ``(class, key)`` is read. Rows without
    a class take no part. The table has one row per class and is joined, not collected."""
    keys = df.filter(F.col(class_col).isNotNull()).select(
        F.col(class_col).alias("cls"), order_key(id_col, seed).alias("key"))
    keys = keys.withColumn("prefix", F.left("key", F.lit(DIGITS)))
    counts = keys.groupBy("cls", "prefix").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("cls").agg(F.sum("n").alias("size"))
    smallest = sizes.agg(F.min("size")).scalar()
    running = Window.partitionBy("cls").orderBy("prefix")
    cumulated = counts.withColumns({
        "before": F.sum("n").over(running) - F.col("n"),
        "size": F.sum("n").over(Window.partitionBy("cls")),
    })
    wanted = cumulated.withColumn("smallest", smallest).select(
        "cls", "prefix", "before", "n",
        F.posexplode(F.array(*ordinals(F.col("size"), F.col("smallest")))).alias("slot", "ordinal"))
    targets = wanted.filter((F.col("ordinal") > F.col("before")) & (F.col("ordinal") <= F.col("before") + F.col("n")))
    buckets = targets.select("cls", "prefix", "before").distinct()
    # At most one bucket per class and wanted position.
    inside = keys.join(buckets, ["cls", "prefix"]).withColumn(
        "ordinal", F.col("before") + F.row_number().over(
            Window.partitionBy("cls", "prefix").orderBy("key")))
    found = (targets.select("cls", "slot", "ordinal")
             .join(inside.select("cls", "ordinal", "key"), ["cls", "ordinal"])
             .groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("slot", "key"))).alias("keys")))
    slots = len(ordinals(F.lit(0), F.lit(0)))
    return sizes.select("cls").join(found, "cls", "left").select(
        "cls", F.array(*[F.try_element_at("keys", F.lit(i)) for i in range(slots)]).alias("at"))


def with_cutoffs(df: DataFrame, class_col: str, id_col: str, seed: int, cutoffs: DataFrame) -> DataFrame:
    """``df`` with ``_key`` and ``_at``, the cut-offs of its class; null without one."""
    return df.withColumn("_key", order_key(id_col, seed)).join(
        cutoffs.select(F.col("cls").alias("_cls"), F.col("at").alias("_at")), F.col(class_col) == F.col("_cls"), "left").drop("_cls")


def at_or_before(class_col: str, slot: int) -> Column:
    """True for rows whose key is within the cut-off of their class, NULL for rows
    without a class."""
    return F.when(F.col(class_col).isNotNull(), F.coalesce(F.col("_key") <= F.col("_at")[slot], F.lit(False)))


def renumber(df: DataFrame, id_col: str, seed: int = 42, new_col: str = "new_id") -> DataFrame:
    """Dense numbers 1..n in seeded random order.

    Bucket offsets are a table of at most 16**DIGITS rows, whatever the input, so
    that side may be broadcast; the rows themselves are shuffled once, by bucket."""
    bucket = F.left(order_key(id_col, seed), F.lit(DIGITS))
    offsets = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    # Single-task window over the bucket counts only.
    offsets = offsets.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    keyed = df.withColumns({"_key": order_key(id_col, seed), "_bucket": bucket})
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", id_col))
    return (keyed.withColumn("_rank", rank).join(F.broadcast(offsets), "_bucket")
            .withColumn(new_col, F.col("_before") + F.col("_rank"))
            .drop("_bucket", "_key", "_before", "_rank"))
