"""Plans: filters on stored columns reach the scan through every feature table, and
filters on features stay above the computation."""

import pytest
from pyspark.sql import functions as F

from baitwatch.operators.features import mail_features, with_header_features, with_text_features
from baitwatch.functions.urls import with_url_features


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def mails(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("mails") / "t")
    spark.range(50).select(
        F.col("id").alias("mail_id"), (F.col("id") % 2).cast("int").alias("label"),
        F.lit("One. Two http://a.example/x urgent payment.").alias("body_text"),
        F.lit("From: a@b.example\n\nOne.").alias("raw_email_source"), F.lit("http://a.example/x").alias("url")).write.parquet(path)
    return spark.read.parquet(path)


def test_filters_on_stored_columns_reach_the_scan(mails):
    tables = {
        "wide": mail_features(mails), "urls": with_url_features(mails.select("mail_id", "url")),
        "text": with_text_features(mails, "body_text"), "headers": with_header_features(mails, "raw_email_source")}
    for name, df in tables.items():
        found = df.filter("mail_id = 7")
        assert "PushedFilters: [IsNotNull(mail_id), EqualTo(mail_id,7)]" in plan(found), name
        assert found.count() == 1


def test_filters_on_features_do_not_repeat_the_work(mails):
    wide = mail_features(mails, attachments=False)
    filtered = wide.filter("text__word_count > 3 and url__num_urls > 0")
    assert plan(filtered).count("regexp_count") == plan(wide).count("regexp_count")
    assert filtered.count() == 50
