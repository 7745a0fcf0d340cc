"""Cross-channel rows: mail and media verdicts with registry answers, incidents,
and plain-language texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import flag
from .registry import verify_executives, verify_senders


def mail_verdicts(scored: DataFrame, senders: DataFrame, on: str = "mail_id") -> DataFrame:
    """Scored mails plus the sender check. ``senders`` holds ``from_addr``."""
    return scored.join(verify_senders(senders), on, "left")


def media_with_claims(verdicts: DataFrame, claims: DataFrame, executives: DataFrame,
                      entities: DataFrame, synthetic: tuple[str, ...] = ("DEEPFAKE", "SYNTHETIC")) -> DataFrame:
    """Add the claimed speaker's check and ``executive_impersonation``: an
    authorised name on a synthetic recording."""
    checked = verify_executives(claims, executives, entities)
    out = verdicts.join(checked, "media_id", "left")
    return out.withColumn("executive_impersonation", flag(
        F.col("executive_authorized") & F.col("risk_tier").isin(*synthetic)))


def incident_report(channels: dict[str, DataFrame], keys: str | tuple[str, ...] = "incident_id") -> DataFrame:
    """One row per incident with the tier and score of every channel, NULL where
    a channel saw nothing. Channel tables hold the keys, ``risk_tier`` and
    ``score``, one row per incident. One aggregation, combined on the map side, serves
    any number of channels."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    sides = [df.select(*keys, F.lit(name).alias("_channel"), "risk_tier", "score") for name, df in channels.items()]
    rows = reduce(lambda a, b: a.unionByName(b), sides)
    return rows.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_channel") == name, F.col(c))).alias(f"{name}_{short}")
        for name in channels for c, short in (("risk_tier", "tier"), ("score", "score"))])


# Fixed texts per channel: (top tier, suspicious, otherwise).
VERDICT_TEXTS = {
    "mail": ("PHISHING", "This email shows strong signs of being a phishing scam.",
             "This email looks suspicious. Proceed with caution.",
             "This email appears to be safe and authentic."),
    "video": ("DEEPFAKE", "This video shows strong evidence of AI manipulation (Deepfake).",
              "This video has suspicious artifacts. It may be manipulated.",
              "This video appears to be an authentic recording."),
    "audio": ("SYNTHETIC", "This voice recording appears to be AI-generated or cloned.",
              "This voice recording has unnatural audio signatures.",
              "This voice recording appears to be human and authentic."),
    "social": ("MANIPULATIVE", "This account or post shows strong signs of being a malicious bot.",
               "This post exhibits suspicious, coordinated behavior.",
               "This post appears to be from a genuine user."),
}

# Fixed texts per feature; the first name contained in the feature decides.
SIGNAL_TEXTS = {
    "text__urgency_word_count": "Contains high-urgency keywords or pressure tactics",
    "text__financial_action_word_count": "Contains demands for financial actions or credentials",
    "text__llm_trope_word_count": "Contains unusual vocabulary favored by AI bots",
    "text__llm_trope_phrase_count": "Contains phrases commonly generated by AI",
    "text__prompt_leakage_detected": "Contains leaked AI prompt artifacts (sloppy bot)",
    "text__out_of_band_excuse_count": "Contains excuses to avoid phone verification",
    "text__causal_connective_count": "Over-justifies its request (common AI behavior)",
    "text__personal_osint_word_count": "Uses scraped personal details",
    "text__personalization_financial_mismatch": "Abruptly pivots from personal chat to asking for money",
    "text__sentence_count": "Abnormal email length (too short or too long)",
    "text__word_count": "Abnormal word count for a professional email",
    "text__burstiness_score": "Structural monotony: sentence lengths are unusually uniform (indicates AI generation)",
    "text__low_burstiness_flag": "Flagged for highly robotic/uniform sentence structure",
    "url__has_suspicious_tld": "Contains links to suspicious or unusual domains (.xyz, etc.)",
    "url__num_urls": "High volume of embedded links",
    "url__has_ip": "Contains raw IP addresses instead of domains",
    "url__has_https": "Uses secure HTTPS (Standard)",
    "header__spf_result_fail": "Sender Policy Framework (SPF) authentication failed",
    "header__dkim_result_fail": "DomainKeys Identified Mail (DKIM) signature failed or missing",
    "header__dmarc_result_fail": "DMARC alignment failed (domain owner policies violated)",
    "header__spf_result_pass": "SPF authentication passed",
    "header__dkim_result_pass": "DKIM signature verified",
    "header__dmarc_result_pass": "DMARC alignment passed",
    "header__message_id_domain_mismatch": "Forged Sender: Message-ID domain does not match the sender domain",
    "header__received_chain_missing": "Missing tracking headers: Email likely generated by a malicious script",
    "header__auth_all_failed":
        "Critical Warning: Failed all cryptographic email authentication checks (SPF/DKIM/DMARC)",
}

# Word in a feature name -> evidence category whose matches are appended.
EVIDENCE_OF = {
    "urgency": "urgency", "financial": "financial", "llm_trope": "llm_tropes",
    "prompt_leakage": "prompt_leakage", "out_of_band": "out_of_band_excuses",
    "causal": "causal_connectives", "personal": "personal_osint",
}


def verdict_text(channel: Column, tier: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, (top, red, yellow, green) in VERDICT_TEXTS.items():
        out = out.when(channel == name, F.when(tier == top, F.lit(red))
                       .when(tier == "SUSPICIOUS", F.lit(yellow)).otherwise(F.lit(green)))
    return out


def signal_text(feature: Column, evidence: Column | None = None) -> Column:
    """Readable text of a feature name, with the words that were matched when
    ``evidence`` (MAP<STRING, ARRAY<STRING>>) has any."""
    known = F.when(F.lit(False), F.lit(""))
    for name, text in SIGNAL_TEXTS.items():
        known = known.when(feature.contains(name), F.lit(text))
    words = F.replace(feature, F.lit("_"), F.lit(" "))
    for channel in ("text", "header", "url"):
        words = F.regexp_replace(words, f"^(.*?){channel}  ", "$1")
    readable = F.coalesce(known, F.concat(F.upper(F.left(words, F.lit(1))), F.substr(words, F.lit(2))))
    if evidence is None:
        return readable
    found = F.when(F.lit(False), F.array().cast("array<string>"))
    for word, category in EVIDENCE_OF.items():
        matches = F.try_element_at(evidence, F.lit(category))
        found = found.when(feature.contains(word) & (F.size(matches) > 0), matches)
    quoted = F.concat(F.lit(' ("'), F.array_join(found, '", "'), F.lit('")'))
    return F.concat(readable, F.coalesce(quoted, F.lit("")))
