"""Tier, decision and per-row signal lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx


def risk_tier(score: Column, top: str) -> Column:
    """SAFE below 0.30, SUSPICIOUS below 0.70, else the channel's own label."""
    return (
        F.when(score < lx.TIER_SAFE_BELOW, F.lit("SAFE"))
        .when(score < lx.TIER_SUSPICIOUS_BELOW, F.lit("SUSPICIOUS"))
        .otherwise(F.lit(top))
    )


def decision(score: Column, positive: str, negative: str) -> Column:
    return F.when(score >= lx.DECISION_AT, F.lit(positive)).otherwise(F.lit(negative))


def active_features(importances: dict[str, float]) -> Column:
    """Features above zero in this row, most important first. An array of at
    most as many entries as there are features. Importances are the same for all rows,
    so the entries stand in their order and no row is sorted."""
    entries = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"))
        for n, _ in sorted(importances.items(), key=lambda x: (-x[1], x[0]))
    ])
    return F.filter(entries, lambda e: e["value"] > 0)


def top_signals(active: Column) -> dict[str, Column]:
    """Split ``active_features`` into the first risk and trust signals."""

    def pick(keep_trust: bool, n: int) -> Column:
        kept = F.filter(active, lambda e: e["feature"].contains(lx.TRUST_MARKER) == keep_trust)
        return F.transform(F.slice(kept, 1, n), lambda e: F.struct(e["feature"], e["value"]))

    return {
        "top_risk_signals": pick(False, lx.TOP_RISK_SIGNALS),
        "top_trust_signals": pick(True, lx.TOP_TRUST_SIGNALS),
    }
