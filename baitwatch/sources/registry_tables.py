"""The six registry tables with their schemas, as Parquet folders, and the rules that
keys, types and states must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns by table; those named in REQUIRED hold no null.
SCHEMAS = {
    "entities": "id long, entity_name string, entity_type string, registration_number string, public_key_pem string, "
                "status string, authorized_by_id long, created_at timestamp, revoked_at timestamp",
    "entity_domains": "entity_id long, domain string",
    "entity_phones": "entity_id long, phone_number string",
    "entity_handles": "entity_id long, platform string, handle string",
    "entity_executives": "entity_id long, executive_name string",
    "signed_communications": "entity_id long, content_hash string, signature_b64 string, verification_token string, "
                             "channel string, subject string, created_at timestamp",
}
REQUIRED = {
    "entities": ("id", "entity_name", "entity_type", "public_key_pem", "status"),
    "entity_domains": ("entity_id", "domain"),
    "entity_phones": ("entity_id", "phone_number"),
    "entity_handles": ("entity_id", "platform", "handle"),
    "entity_executives": ("entity_id", "executive_name"),
    "signed_communications": ("entity_id", "content_hash", "signature_b64", "verification_token"),
}
UNIQUE = {
    "entities": ("id",), "entity_domains": ("domain",), "entity_phones": ("phone_number",),
    "entity_handles": ("platform", "handle"), "signed_communications": ("verification_token",),
}
STATES = ("active", "revoked")


def save_registry(tables: dict[str, DataFrame], folder: str) -> None:
    """Write a snapshot; columns are put in order and cast, missing ones are null."""
    for name, df in tables.items():
        fields = [c.strip().split(" ") for c in SCHEMAS[name].split(",")]
        df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields]).write.mode(
            "overwrite").parquet(f"{folder}/{name}")


def load_registry(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()}


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, rule, n_rows`` of every broken rule: a null where none may be, an
    unknown state, a key held twice."""
    found = []
    for name, df in tables.items():
        for c in REQUIRED[name]:
            found.append(df.filter(F.col(c).isNull()).agg(F.count("*").alias("n_rows")).select(
                F.lit(name).alias("table_name"), F.lit(f"{c} is null").alias("rule"), "n_rows"))
        if name in UNIQUE:
            twice = df.dropna(subset=list(UNIQUE[name])).groupBy(*UNIQUE[name]).agg(F.count("*").alias("n")).filter("n > 1")
            found.append(twice.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).select(
                F.lit(name).alias("table_name"), F.lit(f"{', '.join(UNIQUE[name])} repeats").alias("rule"), "n_rows"))
        if "status" in df.columns:
            found.append(df.filter(~F.col("status").isin(*STATES)).agg(F.count("*").alias("n_rows")).select(
                F.lit(name).alias("table_name"), F.lit("status is unknown").alias("rule"), "n_rows"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.filter("n_rows > 0")
