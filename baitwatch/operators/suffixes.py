"""Registrable domains under a public-suffix rule table with all three kinds of rules:
plain (``co.uk``), wildcard (``*.ck``: every label under it is a suffix) and exception
(``!www.ck``: no suffix after all)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.domains import IPV4


def with_registrable(hosts: DataFrame, rules: DataFrame, host_col: str = "host", rule_col: str = "rule") -> DataFrame:
    """``hosts`` with ``subdomain, domain, suffix, full_domain``.

    Every tail of a host ("a.b.c", "b.c", "c") is looked up in one hash join as a plain
    rule, as an exception and, its first label aside, as a wildcard. An exception wins
    and takes one label off; else the longest match; a host no rule matches has its last
    label as suffix. The rule table may be of any size; each distinct host is worked out
    once. Hosts are lower case without trailing dot; addresses and null hosts have no
    suffix; a host that is a suffix has no domain; repeated rules count once."""
    tail = F.expr("array_join(slice(_labels, i + 1, size(_labels)), '.')")
    distinct = hosts.select(F.col(host_col).alias("_host")).where(F.col("_host").isNotNull() & ~F.col("_host").rlike(IPV4)).distinct()
    tails = distinct.withColumn("_labels", F.split("_host", r"\.", -1)).select(
        "_host", "_labels", F.explode(F.sequence(F.lit(0), F.size("_labels") - 1)).alias("i")).select(
        "_host", (F.size("_labels") - F.col("i")).alias("_n"), tail.alias("_tail"))
    # Behind the first label of a tail, the part that a wildcard names.
    parent = F.expr("substr(_tail, instr(_tail, '.') + 1)")
    asked = tails.select("_host", "_n", F.inline(F.array(
        F.struct(F.col("_tail").alias("_key"), F.lit(0).alias("_off")),
        F.struct(F.concat(F.lit("!"), F.col("_tail")).alias("_key"), F.lit(1).alias("_off")),
        F.struct(F.when(F.col("_n") > 1, F.concat(F.lit("*."), parent)).alias("_key"), F.lit(0).alias("_off")))))
    listed = rules.select(F.lower(rule_col).alias("_key")).distinct()
    match = asked.join(listed, "_key").groupBy("_host").agg(
        F.max(F.struct((F.col("_off") == 1).alias("exception"), (F.col("_n") - F.col("_off")).alias("n"))).alias("_m"))
    found = match.select(F.col("_host").alias("_of"), F.col("_m.n").alias("_k"))
    out = hosts.join(found, F.col(host_col) == F.col("_of"), "left").drop("_of")
    host, ip = F.col(host_col), F.col(host_col).rlike(IPV4)
    out = out.withColumn("_labels", F.split(host, r"\.", -1)).withColumn("_k", F.when(ip, 0).otherwise(F.coalesce("_k", F.lit(1))))
    n = F.size("_labels")
    part = lambda a, b: F.array_join(F.slice("_labels", a, F.greatest(b, F.lit(0))), ".")
    out = out.withColumns({
        "suffix": F.when(ip, "").otherwise(part(n - F.col("_k") + 1, F.col("_k"))),
        "domain": F.when(ip, host).when(n > F.col("_k"), F.get("_labels", n - F.col("_k") - 1)).otherwise(F.when(host.isNotNull(), "")),
        "subdomain": F.when(ip, "").otherwise(part(F.lit(1), n - F.col("_k") - 1)),
    })
    return out.withColumn("full_domain", F.concat("domain", F.lit("."), "suffix")).drop("_labels", "_k")
