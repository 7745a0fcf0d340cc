"""Assembly of labelled tables: union, counts, balance, split, sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import strip
from .ordering import at_or_before, class_cutoffs, order_key, with_cutoffs

MIN_BODY_CHARS = 10


def drop_short_bodies(df: DataFrame, body_col: str = "body_text") -> DataFrame:
    return df.filter(F.length(strip(F.col(body_col))) >= MIN_BODY_CHARS)


def union_mails(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_rows"))


def balance_classes(df: DataFrame, class_col: str = "label", id_col: str = "mail_id",
                    seed: int = 42) -> DataFrame:
    """Every class cut down to the size of the smallest, in seeded random order. Rows
    meet a table of one row per class; Spark broadcasts it while it is small."""
    cut = class_cutoffs(df, class_col, id_col, seed, lambda size, smallest: [smallest])
    rows = with_cutoffs(df, class_col, id_col, seed, cut)
    return rows.filter(at_or_before(class_col, 0)).select(df.columns)


def stratified_split(df: DataFrame, test_fraction: float = 0.2, class_col: str = "label",
                     id_col: str = "mail_id", seed: int = 42) -> DataFrame:
    """Add ``is_test``: the same share of every class, exact to one row."""
    cut = class_cutoffs(df, class_col, id_col, seed, lambda size, _: [
        F.floor(size * F.lit(test_fraction) + F.lit(0.5))])
    rows = with_cutoffs(df, class_col, id_col, seed, cut)
    return rows.select(*df.columns, at_or_before(class_col, 0).alias("is_test"))


def stratified_folds(df: DataFrame, folds: int = 5, class_col: str = "label",
                     id_col: str = "mail_id", seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..folds-1, classes spread evenly."""
    cut = class_cutoffs(df, class_col, id_col, seed, lambda size, _: [
        F.floor(size * F.lit(k) / F.lit(folds)) for k in range(1, folds)])
    rows = with_cutoffs(df, class_col, id_col, seed, cut)
    fold = F.lit(folds - 1)
    for k in range(folds - 1):
        fold = fold - at_or_before(class_col, k).cast("int")
    return rows.select(*df.columns, fold.alias("fold"))


def capped_sample(df: DataFrame, max_rows: int, id_col: str, seed: int = 42) -> DataFrame:
    """Random sample of at most ``max_rows`` rows. Each task keeps its own
    smallest keys before they are merged."""
    return (df.withColumn("_key", order_key(id_col, seed)).orderBy("_key", id_col)
            .limit(max_rows).drop("_key"))
