"""Scans over landing folders. The mail and post plans are the batch plans: they
are narrow, so they run in append mode without state or watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.registry import verify_handles
from ..operators.report import incident_report
from ..operators.scan import scan_mails
from ..operators.social import scan_posts
from ..sources.uploads import check_uploads

MAIL_INPUT = T.StructType([
    T.StructField("mail_id", T.LongType()),
    T.StructField("body_text", T.StringType()),
    T.StructField("raw_email_source", T.StringType()),
])
POST_INPUT = T.StructType([
    T.StructField("post_id", T.LongType()),
    T.StructField("post_text", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("handle", T.StringType()),
    T.StructField("bio_text", T.StringType()),
    T.StructField("account_created_date", T.StringType()),
    T.StructField("posts_per_day", T.DoubleType()),
    T.StructField("followers", T.LongType()),
    T.StructField("following", T.LongType()),
    T.StructField("image_applicable", T.BooleanType()),
    T.StructField("image_fake_probability", T.DoubleType()),
])
UPLOAD_INPUT = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("length", T.LongType()),
])


def read_landing(spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet",
                 max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(file_format).load(path)


def missing_field(*required: str) -> Column:
    """Reason of rejection, NULL when every required field is present."""
    return F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"missing_{c}")) for c in required])


def as_json(df: DataFrame, key: str) -> DataFrame:
    """``(key, value)`` with the row as a JSON answer."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def first_deliveries(mails: DataFrame, received: str = "received_at", delay: str = "1 day") -> DataFrame:
    """Mails without repeated deliveries of one ``mail_id`` within ``delay`` of each other.
    State holds the ids of that time only; the watermark lets older ones go."""
    return mails.withWatermark(received, delay).dropDuplicatesWithinWatermark(["mail_id"])


def scan_mail_stream(mails: DataFrame, model: PipelineModel) -> DataFrame:
    return scan_mails(mails.filter(missing_field("body_text", "raw_email_source").isNull()), model)


def scan_post_stream(posts: DataFrame, handles: DataFrame, entities: DataFrame, as_of: Column) -> DataFrame:
    """Post verdicts joined to the static registry by (platform, handle)."""
    valid = posts.filter(missing_field("post_text").isNull())
    scanned = scan_posts(valid, as_of, ("post_id", "platform", "handle"))
    return verify_handles(scanned, handles, entities)


def route_posts(posts: DataFrame, registry: Callable[[], tuple[DataFrame, DataFrame]], as_of: Column,
                scanned: str, checkpoint: str) -> StreamingQuery:
    """Post verdicts with the registry as it is at each micro-batch: ``registry`` gives
    handles and entities anew, so an entity revoked meanwhile is no longer verified."""
    def one(batch: DataFrame, batch_id: int) -> None:
        write_batch_once(scan_post_stream(batch, *registry(), as_of), scanned, batch_id)

    return (posts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def write_stream(df: DataFrame, out: str, checkpoint: str, file_format: str = "parquet") -> StreamingQuery:
    """Process what has landed, then stop; restart resumes at the checkpoint."""
    return (df.writeStream.format(file_format).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out))


def write_batch_once(df: DataFrame, out: str, batch_id: int) -> None:
    """A folder per micro-batch, overwritten on retry: no duplicates."""
    df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def route_uploads(uploads: DataFrame, accepted: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Two sinks from one pass: accepted uploads, and rejects with a reason."""

    def both(batch: DataFrame, batch_id: int) -> None:
        checked = check_uploads(batch).persist()
        write_batch_once(checked.filter("accepted").drop("reason", "accepted"), accepted, batch_id)
        write_batch_once(checked.filter("not accepted").drop("accepted"), rejected, batch_id)
        checked.unpersist()

    return (uploads.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def route_mails(mails: DataFrame, model: PipelineModel, scanned: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Verdicts of readable mails and rejects with a reason, in two sinks."""
    reason = missing_field("body_text", "raw_email_source")

    def both(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        write_batch_once(scan_mail_stream(batch, model), scanned, batch_id)
        write_batch_once(batch.withColumn("reason", reason).filter("reason is not null"), rejected, batch_id)
        batch.unpersist()

    return (mails.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def incident_stream(channels: dict[str, DataFrame], seen: str = "seen_at", delay: str = "1 hour", span: str = "1 day") -> DataFrame:
    """The incident table over streams of verdicts: a row per incident and ``span`` of
    event time, ``day`` being its begin, in update mode. Channel streams hold
    ``incident_id, risk_tier, score`` and ``seen``; they may fall behind each other by
    ``delay``, after which a span's state goes."""
    timed = {name: df.withWatermark(seen, delay).select(
        "incident_id", F.window(seen, span)["start"].alias("day"), "risk_tier", "score") for name, df in channels.items()}
    return incident_report(timed, ("incident_id", "day"))


def route_incidents(incidents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Changed incidents of each micro-batch in a folder of their own."""
    return (incidents.writeStream.outputMode("update").foreachBatch(lambda batch, n: write_batch_once(batch, out, n))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_incidents(spark: SparkSession, out: str) -> DataFrame:
    """Each incident as its last change left it."""
    rows = spark.read.parquet(out)
    keys, rest = ["incident_id", "day"], [c for c in rows.columns if c not in ("incident_id", "day", "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")
