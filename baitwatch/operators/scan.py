"""The complete answer for a mail, batch or stream: one narrow plan."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import CATEGORICAL, mail_features, one_hot_auth
from .learn import importances, model_columns, score_mails, with_top_signals
from .registry import verify_senders


def model_vocabulary(model: PipelineModel) -> list[str]:
    """Authentication results the model was fitted with."""
    heads = [f"header__{n}_" for n in CATEGORICAL]
    return sorted({c.removeprefix(h) for c in model_columns(model) for h in heads if c.startswith(h)})


def scan_mails(mails: DataFrame, model: PipelineModel) -> DataFrame:
    """``(mail_id, body_text, raw_email_source)`` -> probability, tier, decision,
    signals, sender check and text matches. No join and no shuffle. Filter mails before
    this call: Spark's feature assembler lets no filter pass below it."""
    wide = mail_features(mails.select("mail_id", "body_text", "raw_email_source"), keep=("mail_id",), matches=True)
    hot = one_hot_auth(wide, model_vocabulary(model))
    scored = score_mails(model, hot, ("mail_id", "from_addr", "text_matches"))
    signals = with_top_signals(scored, importances(model))
    return verify_senders(signals).select(
        "mail_id", "phishing_probability", "risk_tier", "prediction", "top_risk_signals", "top_trust_signals",
        "sender_verified", "sender_entity", "domain_checked", "text_matches",
        F.struct(*model_columns(model)).alias("raw_features"))
