"""Account behaviour and post risk as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx
from .numbers import round_exact
from .strings import any_of, count_of, count_terms, flag

BEHAVIOUR_FEATURES = [
    "account_age_days", "very_new_account", "posts_per_day", "abnormal_posting_frequency",
    "follower_following_ratio", "suspicious_follow_ratio", "suspicious_handle_pattern",
    "suspicious_bio_keyword_count", "behavioral_red_flag_count", "likely_coordinated_or_bot",
]


def account_age_days(created: Column, as_of: Column) -> Column:
    """Whole days up to ``as_of``; NULL for unknown dates and for values
    that are not as a whole a date, with or without a time."""
    time = r"[T ][0-2][0-9](:[0-5][0-9](:[0-5][0-9](\.[0-9]{1,6})?)?)?"
    iso = F.when(created.rlike(rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}({time})?$"), created)
    return F.date_diff(as_of, F.try_to_date(F.left(iso, F.lit(10)), "yyyy-MM-dd"))


def behaviour_stage(as_of: Column):
    def stage(get) -> dict[str, Column]:
        age = account_age_days(get("account_created_date"), as_of)
        followers, following = get("followers"), get("following")
        ratio = F.when(following != 0, followers / following)
        return {
            "account_age_days": age,
            "very_new_account": flag(age < lx.NEW_ACCOUNT_DAYS),
            "abnormal_posting_frequency": flag(get("posts_per_day") > lx.MAX_POSTS_PER_DAY),
            "follower_following_ratio": round_exact(ratio, 3),
            "suspicious_follow_ratio": flag((following > lx.SPAM_FOLLOWING) & (ratio < lx.SPAM_FOLLOW_RATIO)),
            "suspicious_handle_pattern": flag(any_of(get("handle").rlike(p) for p in lx.HANDLE_PATTERNS)),
            "suspicious_bio_keyword_count": F.coalesce(
                count_terms(F.lower(get("bio_text")), lx.BIO_KEYWORDS), F.lit(0)),
        }

    return stage


def red_flag_stage(get) -> dict[str, Column]:
    flags = count_of([
        get("very_new_account"), get("abnormal_posting_frequency"), get("suspicious_follow_ratio"),
        get("suspicious_handle_pattern"), get("suspicious_bio_keyword_count") > 0,
    ])
    return {"behavioral_red_flag_count": flags, "likely_coordinated_or_bot": flags >= lx.BOT_RED_FLAGS}


TEXT_RISK_FEATURES = ["urgency_financial_combo", "personalization_financial_mismatch", "prompt_leakage_detected",
                      "out_of_band_excuse_count", "low_burstiness_flag", "llm_trope_word_count"]


def text_risk(get) -> Column:
    """Weighted sum of the signals that fired, capped at 1."""
    fired = {
        "urgency_financial_combo": get("urgency_financial_combo"),
        "personalization_financial_mismatch": get("personalization_financial_mismatch"),
        "prompt_leakage_detected": get("prompt_leakage_detected"),
        "out_of_band_excuse": get("out_of_band_excuse_count") > 0,
        "low_burstiness_flag": get("low_burstiness_flag"),
        "many_tropes": get("llm_trope_word_count") > 2,
    }
    total = F.lit(0.0)
    for name, weight in lx.TEXT_RISK_WEIGHTS.items():
        total = total + F.when(flag(fired[name]), F.lit(weight)).otherwise(F.lit(0.0))
    return F.least(total, F.lit(1.0))


def behaviour_risk(red_flags: Column) -> Column:
    return F.least(red_flags / F.lit(5.0), F.lit(1.0))


def fused_score(text: Column, behaviour: Column, image: Column, image_applicable: Column) -> Column:
    """Weighted mean; the image counts only where it applies."""
    weight = F.when(flag(image_applicable), F.lit(lx.WEIGHT_IMAGE)).otherwise(F.lit(0.0))
    return (
        text * F.lit(lx.WEIGHT_TEXT)
        + F.coalesce(image, F.lit(0.0)) * weight
        + behaviour * F.lit(lx.WEIGHT_BEHAVIOUR)
    ) / (F.lit(lx.WEIGHT_TEXT) + weight + F.lit(lx.WEIGHT_BEHAVIOUR))
