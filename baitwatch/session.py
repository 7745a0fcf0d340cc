"""Session settings and reliable checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession


def build_session(app: str = "baitwatch", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Reliable checkpoint folder: the one the cluster names in
    ``spark.checkpoint.dir``; a temporary one only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="baitwatch-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return named


def spread(df: DataFrame) -> DataFrame:
    """Deal a table anew into the number of partitions the session asks for in
    ``baitwatch.input.partitions``: for input files of a single row group, which
    Spark can't split. Unset, as on a cluster with many splits, nothing moves."""
    wanted = df.sparkSession.conf.get("baitwatch.input.partitions", None)
    return df.repartition(int(wanted)) if wanted and not df.isStreaming else df


def deal_out(df: DataFrame, *by: Column | str) -> DataFrame:
    """Deal rows over four tasks a core before each grows into much work: a table of keys
    is small enough to come as one split, and a file of texts may be one row group, which
    Spark can't split. Wide rows go by the hash of ``by``; without it Spark sorts them to
    deal them out in turn."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)
