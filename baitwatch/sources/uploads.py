"""Upload manifests: extension allow-list and size cap per kind of media."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import UPLOAD_LIMITS


def read_manifest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``(path, length, kind)`` of stored files; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.lit(kind).alias("kind"))


def check_uploads(manifest: DataFrame) -> DataFrame:
    """Add ``extension``, ``accepted`` and ``reason``; the extension is tested
    before the size."""
    name = F.substring_index("path", "/", -1)
    # A leading dot starts a hidden name, a trailing one ends it: no extension.
    out = manifest.withColumn("extension", F.lower(F.regexp_extract(name, r"^.*[^.].*?(\.[^.]+)$", 1)))
    known, allowed, too_large = F.lit(False), F.lit(False), F.lit(False)
    for kind, (extensions, cap) in UPLOAD_LIMITS.items():
        of_kind = F.col("kind") == kind
        known = known | of_kind
        allowed = allowed | (of_kind & F.col("extension").isin(*extensions))
        too_large = too_large | (of_kind & (F.col("length") > cap))
    reason = (F.when(~known, F.lit("unknown_kind")).when(~allowed, F.lit("unsupported_type"))
              .when(too_large, F.lit("too_large")))
    return out.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
