import statistics

from pyspark.sql import functions as F

from baitwatch.functions import text as X
from baitwatch.operators.features import with_text_features


def features(spark, *bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    return [r for r in with_text_features(df, "body").orderBy("i").collect()]


def test_one_signal_per_body(spark):
    got = features(
        spark,
        "I hope this email finds you well. A seamless plan is crucial, I underscore.",
        "Sitting on a plane now, the in-flight wifi barely works.",
        "Urgent: the offer expires at noon, send the wire transfer immediately.",
        "Your LinkedIn page shows hiking photos. Now pay by wire transfer.",
        "Fine by me. Pay it. Tell Meera about the figures later. Thx.",
        "Sure, here is an email you can send to them.",
    )
    assert got[0]["llm_trope_word_count"] == 3 and got[0]["llm_trope_phrase_count"] == 1
    assert got[1]["out_of_band_excuse_count"] == 2
    assert got[2]["urgency_financial_combo"] and got[2]["urgency_word_count"] == 4
    assert got[3]["personalization_financial_mismatch"]
    assert got[4]["llm_trope_word_count"] == 0 and got[4]["out_of_band_excuse_count"] == 0
    assert not got[4]["personalization_financial_mismatch"]
    assert got[5]["prompt_leakage_detected"]


def test_terms_match_inside_words(spark):
    assert features(spark, "Yours sincerely")[0]["causal_connective_count"] == 1


def test_sentences_keep_abbreviations(spark):
    df = spark.createDataFrame([("Ask Mr. Rao, e.g. now.  Is it ok? Yes! ",)], "t string")
    assert df.select(X.sentences(F.col("t")).alias("s")).first()["s"] == ["Ask Mr. Rao, e.g. now.", "Is it ok?", "Yes!"]


def test_burstiness_is_deviation_over_mean(spark):
    lengths = [3, 9, 1, 4, 4]
    body = " ".join(" ".join(["w"] * n) + "." for n in lengths)
    row = features(spark, body, "One. Two.", "", "a b c. a b c. a b c.")
    assert row[0]["burstiness_score"] == round(statistics.pstdev(lengths) / statistics.mean(lengths), 3)
    assert row[1]["burstiness_score"] == 1.0 and row[2]["sentence_count"] == 0
    assert row[3]["burstiness_score"] == 0.0 and row[3]["low_burstiness_flag"]


def test_evidence_lists_what_matched(spark):
    df = spark.createDataFrame(
        [("urgent: unable to verify by phone, sure, here is an email {{name}}; otp",)], "t string")
    e = df.select(X.evidence(F.col("t")).alias("e")).first()["e"]
    assert e["urgency"] == ["urgent"] and e["financial"] == ["otp"]
    assert e["out_of_band_excuses"] == ["verify"]
    assert e["prompt_leakage"] == ["an ", "{{name}}"]
    assert e["llm_tropes"] == [] and set(e) == {
        "llm_tropes", "prompt_leakage", "out_of_band_excuses", "urgency", "financial", "causal_connectives", "personal_osint"}
