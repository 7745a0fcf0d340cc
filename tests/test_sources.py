import re
import subprocess
import sys
from email import message_from_string

import pytest
from pyspark.sql import functions as F

from baitwatch.functions.lexicons import UPLOAD_LIMITS
from baitwatch.operators.features import align, auth_vocabulary, mail_features, one_hot_auth
from baitwatch.plans.fixtures import fixture
from baitwatch.sources import generator as G
from baitwatch.sources import mail_tables as MT
from baitwatch.sources.uploads import check_uploads, read_manifest


def test_seeds_of_one_split_are_expanded_by_many_tasks(spark):
    mails = G.expand_templates(spark.range(400, numPartitions=1), "id")
    per_task = [r["n"] for r in mails.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    assert sum(per_task) == 400 * len(G.TEMPLATES) and max(per_task) <= sum(per_task) // 4


def test_csv_round_trip(spark, tmp_path):
    odd = [(1, 1, "t", "c", ' "quoted", x', "line one\nline \"two\", end\n\n", "From: a\r\n\r\nb \\ c\n", None),
           (2, 0, "t", "c", None, " ", "₹ ünï", "n")]
    df = spark.createDataFrame(odd, MT.MAIL_SCHEMA)
    MT.write_mail_csv(df, str(tmp_path / "csv"))
    got = sorted(map(tuple, MT.read_mail_csv(spark, str(tmp_path / "csv")).collect()))
    assert got == odd
    MT.write_mail_csv(df.fillna(""), str(tmp_path / "blank"))
    assert sorted(map(tuple, MT.read_mail_csv(spark, str(tmp_path / "blank")).collect())) == odd
    MT.write_mail_parquet(df, str(tmp_path / "parquet"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "parquet")).collect())) == odd


def test_message_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "1").write_bytes(b"Subject: hi\nFrom: a@b.c\n\nA body that is \xff long enough.\n")
    (tmp_path / "in" / "sub" / "2").write_bytes(b"From: a@b.c\n\nshort\n")
    (tmp_path / "in" / "sub" / "3").write_bytes(b"From: a@b.c\n\nno subject, long enough\n")
    got = MT.read_message_files(spark, str(tmp_path / "in"), 0, "easy_ham").orderBy("subject").collect()
    assert [r["subject"] for r in got] == ["(no subject)", "hi"]
    assert got[1]["body_text"] == "A body that is � long enough.\n" and got[1]["category"] == "Real: Easy Ham"


def test_partial_headers_read_back(spark, small):
    for r in MT.from_partial_headers(fixture(spark, small, "partial")).limit(50).collect():
        message = message_from_string(r["raw_email_source"])
        assert message["Subject"] == r["subject"] and "spf=none" in message["Authentication-Results"]
        assert "," not in message["To"] and message.get_payload() == r["body_text"] + "\n"


def test_upload_limits(spark, tmp_path):
    cap = UPLOAD_LIMITS["image"][1]
    cases = [("a/b.PNG", "image", cap, True, None), ("b.png", "image", cap + 1, False, "too_large"),
             ("malicious.exe", "image", cap + 1, False, "unsupported_type"), ("x.webm", "audio", 1, True, None),
             ("x.webm", "text", 1, False, "unknown_kind"), ("d.ir/noext", "video", 1, False, "unsupported_type"),
             (".mp4", "video", 1, False, "unsupported_type"), ("a.tar.mp4", "video", 0, True, None)]
    df = spark.createDataFrame([c[:3] for c in cases], "path string, kind string, length long")
    got = {(r["path"], r["kind"], r["length"]): (r["accepted"], r["reason"]) for r in check_uploads(df).collect()}
    assert got == {c[:3]: c[3:] for c in cases}
    (tmp_path / "v.mov").write_bytes(b"123")
    row = check_uploads(read_manifest(spark, str(tmp_path), "video")).first()
    assert row["accepted"] and row["length"] == 3


def test_capped_text_table(spark):
    df = spark.range(300).select("id", F.lit("text that is long enough").alias("text"), F.lit(0).alias("label"))
    assert MT.from_text_labels(df, 100).count() == 100 and MT.from_text_labels(df, None).count() == 300


@pytest.fixture(scope="module")
def generated(spark):
    return G.expand_templates(spark.range(40), "id").cache()


def test_templates_expand_evenly(generated):
    counts = generated.groupBy("template_id").count().collect()
    assert len(counts) == len(G.TEMPLATES) and {r["count"] for r in counts} == {40}
    assert generated.select("id").distinct().count() == generated.count()
    assert generated.filter("body_text rlike '[{}]' or subject rlike '[{}]'").count() == 0
    assert {t[2] for t in G.TEMPLATES} == {"ip_address", "shortener", "email_embedded", "typosquat", "at_symbol", "none", "clean"}


def test_generated_mails_carry_the_intended_signals(spark, generated):
    wide = mail_features(generated.withColumnRenamed("id", "mail_id"), ("mail_id", "label", "template_id"), attachments=False)
    got = {r["template_id"]: r for r in wide.groupBy("template_id").agg(
        F.min("label").alias("label"), F.avg("header__auth_all_failed").alias("failed"),
        F.avg("url__is_shortened").alias("short"), F.avg("url__is_ip_address").alias("ip"),
        F.avg("header__sender_uses_free_email").alias("free"), F.avg("url__has_at_symbol_trick").alias("at"),
        F.avg("text__out_of_band_excuse_count").alias("excuse")).collect()}
    assert got["bait_tax_surplus"]["short"] == 1 and got["bait_tax_surplus"]["free"] == 1
    assert got["bait_parcel_duty"]["ip"] == 1 and got["bait_bonus_units"]["at"] == 1
    assert got["bait_chief_travelling"]["excuse"] == 3 and got["bait_frozen_holdings"]["failed"] == 1
    assert all(r["failed"] == 0 for r in got.values() if r["label"] == 0)


def test_spoofed_domains_use_every_mutation(spark):
    df = spark.range(200).select(F.lit("zerodha.com").alias("real"), "id")
    got = {r[0].rsplit(".", 1)[0] for r in df.select(G.spoof_domain(F.col("real"), F.col("id"))).collect()}
    assert "zerodha" in got and "zer-odha" in got and any(g.startswith("zerodha") and len(g) > 8 for g in got)
    assert any(sorted(g) == sorted("zerodha") and g != "zerodha" for g in got)


def test_vocabulary_and_alignment(spark):
    df = spark.createDataFrame([("pass", "temperror", "none", 1)],
                               "header__spf_result string, header__dkim_result string, header__dmarc_result string, a int")
    words = auth_vocabulary(df)
    assert words == ["pass", "fail", "none", "softfail", "neutral", "temperror"]
    hot = one_hot_auth(df, words).first()
    assert hot["header__dkim_result_temperror"] == 1 and hot["header__spf_result_pass"] == 1 and hot["header__spf_result_fail"] == 0
    assert align(df, ["a", "missing"]).first().asDict() == {"a": 1, "missing": 0}


def test_worker_functions_need_no_package(spark):
    """What is sent to executors must not import this package."""
    from baitwatch.functions.mime import _filenames_udf, _text_part_udf
    from baitwatch.functions.signatures import _signature_udf
    from pyspark import cloudpickle

    for udf in (_filenames_udf(), _text_part_udf(), _signature_udf()):
        sent = cloudpickle.dumps(udf.func)
        code = "import sys, pickle; sys.modules['baitwatch'] = None; pickle.loads(sys.stdin.buffer.read())"
        done = subprocess.run([sys.executable, "-c", code], input=sent, capture_output=True, cwd="/", timeout=120)
        assert done.returncode == 0, done.stderr[-500:]


ODD_FIELDS = ['a "quoted" word', "two\nlines", '"', "", 'ends with "', "x\r\ny", ',"\n,"\n', "plain", 'é🙂 "日本"\n\n\n"', None]


def _odd_mails(spark, n):
    rows = [(k, k % 2, "t", "c", ODD_FIELDS[k % 10], f"{ODD_FIELDS[k * 7 % 10]}{k}\n" * (k % 4 + 1), ODD_FIELDS[k * 3 % 10], None) for k in range(n)]
    return spark.createDataFrame(rows, MT.MAIL_SCHEMA)


@pytest.mark.parametrize("split", [37, 1000, 1 << 27])
def test_quoted_csv_is_the_same_for_every_split(spark, tmp_path, split):
    """One file, fields with line ends and quotation marks, ranges that begin anywhere."""
    want = [tuple(v or None for v in r[1:]) for r in _odd_mails(spark, 150).orderBy("id").collect()]
    MT.write_mail_csv(_odd_mails(spark, 150).coalesce(1), str(tmp_path / "csv"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        read = MT.read_mail_csv(spark, str(tmp_path / "csv")).orderBy("id").collect()
        n_tasks = spark.read.text(str(tmp_path / "csv")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert [r["id"] for r in read] == list(range(150))
    assert [tuple(v or None for v in r[1:]) for r in read] == want
    assert n_tasks > 1 or split == 1 << 27


def test_csv_records_of_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h1,h2\n1,"x\ny"\n2,""""\n')
    (tmp_path / "b.csv").write_text('h1,h2\n3,z')
    (tmp_path / "c.csv").write_text("")
    got = sorted((r["path"][-5:], r["n"], r["record"]) for r in MT.csv_records(spark, str(tmp_path)).collect())
    assert got == [("a.csv", 1, "h1,h2"), ("a.csv", 2, '1,"x\ny"'), ("a.csv", 3, '2,""""'), ("b.csv", 1, "h1,h2"), ("b.csv", 2, "3,z")]


def test_quoted_csv_shuffles_no_lines(spark, tmp_path):
    """Only sums and cut records, a row a range, are dealt out."""
    (tmp_path / "a.csv").write_bytes(b'h1,h2\n1,"x\n\xff"\n2,"y\n\n"\n')
    records = MT.csv_records(spark, str(tmp_path))
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path" in plan and not re.search(r"hashpartitioning\([^)]*block", plan)
    assert sorted((r["n"], bytes(r["b"])) for r in records.select("n", F.col("record").cast("binary").alias("b")).collect()) == [
        (1, b"h1,h2"), (2, b'1,"x\n\xff"'), (3, b'2,"y\n\n"')]
