import datetime

import pytest
from pyspark.sql import functions as F

from baitwatch.functions.scoring import decision, risk_tier
from baitwatch.functions.social import text_risk
from baitwatch.operators.report import incident_report, signal_text, verdict_text
from baitwatch.operators.social import scan_posts, with_behaviour

AS_OF = datetime.date(2026, 7, 10)
SCHEMA = ("post_id int, post_text string, handle string, bio_text string, account_created_date string, "
          "posts_per_day double, followers int, following int, image_applicable boolean, image_fake_probability double")
PUSHY = "The window expires tonight, so act now. Make the payment and keep your place."
BOT = ("coin_calls_5550123", "Guaranteed returns, 100x! DM for signals.", "2026-07-05", 45.0, 12, 3000)
PERSON = ("meera_saves", "I hold index funds.", "2018-05-02", 0.8, 850, 400)
NOBODY = (None,) * 6


@pytest.fixture(scope="module")
def scans(spark):
    rows = [
        (1, PUSHY, *BOT, None, None), (2, "Shares closed mixed. Banks fell.", *PERSON, None, None),
        (3, PUSHY, *NOBODY, None, None), (4, PUSHY, *NOBODY, False, 0.9), (5, "Neutral text.", *NOBODY, True, 0.95),
        (6, "x", "h", None, "not a date", None, 5, 0, None, None), (7, "", *NOBODY, True, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return ({r["post_id"]: r for r in scan_posts(df, F.lit(AS_OF)).collect()},
            {r["post_id"]: r for r in with_behaviour(df, F.lit(AS_OF)).collect()})


def test_manipulative_and_normal_account(scans):
    posts, accounts = scans
    assert posts[1]["risk_tier"] in ("SUSPICIOUS", "MANIPULATIVE") and posts[1]["fused_risk_score"] > 0.3
    assert accounts[1]["behavioral_red_flag_count"] == 5 and accounts[1]["account_age_days"] == 5
    assert posts[2]["risk_tier"] == "SAFE" and accounts[2]["behavioral_red_flag_count"] == 0
    assert accounts[2]["follower_following_ratio"] == 2.125


def test_unknown_never_raises_a_flag(scans):
    row = scans[1][3]
    assert row["account_age_days"] is None and row["very_new_account"] is False
    assert row["behavioral_red_flag_count"] == 0 and row["likely_coordinated_or_bot"] is False
    assert scans[1][6]["account_age_days"] is None and scans[1][6]["follower_following_ratio"] is None


def test_image_weight_is_dropped_when_it_does_not_apply(scans):
    posts = scans[0]
    assert posts[3]["fused_risk_score"] == pytest.approx(0.35 * 0.4 / 0.7, abs=1e-4)
    assert posts[3]["image_risk_score"] is None and posts[3]["image_applicable"] is None
    assert posts[4]["fused_risk_score"] == posts[3]["fused_risk_score"]
    assert posts[4]["image_applicable"] is False and posts[4]["image_risk_score"] == 0.0
    assert posts[5]["image_risk_score"] == 0.95 and posts[5]["fused_risk_score"] == pytest.approx(0.285)
    assert posts[7]["fused_risk_score"] == 0.0


@pytest.mark.parametrize("fired, expected", [
    (dict(urgency_financial_combo=True), 0.35), ({}, 0.0),
    (dict(urgency_financial_combo=True, personalization_financial_mismatch=True, prompt_leakage_detected=True,
          out_of_band_excuse_count=3, low_burstiness_flag=True, llm_trope_word_count=5), 1.0),
    (dict(llm_trope_word_count=2), 0.0), (dict(llm_trope_word_count=3), 0.02),
])
def test_text_risk_weights(spark, fired, expected):
    values = dict(urgency_financial_combo=False, personalization_financial_mismatch=False, prompt_leakage_detected=False,
                  out_of_band_excuse_count=0, low_burstiness_flag=False, llm_trope_word_count=0) | fired
    row = spark.range(1).select(text_risk(lambda n: F.lit(values[n])).alias("r")).first()
    assert row["r"] == pytest.approx(expected)


def test_tier_edges_and_monotone(spark):
    scores = [0.0, 0.29, 0.30, 0.69, 0.70, 1.0]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    got = [tuple(r) for r in df.select(risk_tier(F.col("s"), "TOP"), decision(F.col("s"), "yes", "no")).collect()]
    assert [g[0] for g in got] == ["SAFE", "SAFE", "SUSPICIOUS", "SUSPICIOUS", "TOP", "TOP"]
    assert [g[1] for g in got] == ["no", "no", "no", "yes", "yes", "yes"]


def test_handles(spark):
    names = {"user70011223": True, "user1": True, "account77": True, "Account77": False, "a___b": True, "a__b": False,
             "x12345": False}
    df = spark.createDataFrame([(n, None, None, None, None, None) for n in names],
                               "handle string, bio_text string, account_created_date string, posts_per_day double, "
                               "followers int, following int")
    got = {r["handle"]: r["suspicious_handle_pattern"] for r in with_behaviour(df, F.lit(AS_OF)).collect()}
    assert got == names


def test_texts(spark):
    evidence = F.expr("map('urgency', array('asap','urgent'), 'financial', array())")
    row = spark.range(1).select(
        verdict_text(F.lit("mail"), F.lit("PHISHING")).alias("a"),
        verdict_text(F.lit("social"), F.lit("SAFE")).alias("b"),
        signal_text(F.lit("text__urgency_word_count"), evidence).alias("c"),
        signal_text(F.lit("header__suspicious_mailer")).alias("d"),
        signal_text(F.lit("text__financial_action_word_count"), evidence).alias("e"),
    ).first()
    assert row["a"].startswith("This email shows") and row["b"].endswith("genuine user.")
    assert row["c"] == 'Contains high-urgency keywords or pressure tactics ("asap", "urgent")'
    assert row["d"] == "Suspicious mailer" and row["e"].endswith("credentials")


def test_incidents_keep_missing_channels(spark):
    mail = spark.createDataFrame([(1, "PHISHING", 0.9)], "incident_id int, risk_tier string, score double")
    voice = spark.createDataFrame([(1, "SAFE", 0.1), (2, "SYNTHETIC", 0.8)], "incident_id int, risk_tier string, score double")
    got = {r["incident_id"]: (r["mail_tier"], r["audio_tier"]) for r in incident_report({"mail": mail, "audio": voice}).collect()}
    assert got == {1: ("PHISHING", "SAFE"), 2: (None, "SYNTHETIC")}
