import random
import time
from urllib.parse import urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from baitwatch.functions import urls as U
from baitwatch.functions.domains import host_of, registrable, suffix_stages
from baitwatch.operators.suffixes import with_registrable
from baitwatch.operators.typosquat import flag_lookalikes
from baitwatch.operators.features import mail_features, with_url_summary
from baitwatch.operators.urls import aggregate_url_rows, explode_urls


def summary(spark, *bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "mail_id int, body string")
    return {r["mail_id"]: r for r in with_url_summary(df, "body").collect()}


def test_one_signal_per_body(spark):
    got = summary(
        spark,
        "Check http://sebi-kyc-verify.top/x/y",
        "Open http://10.20.30.40/in",
        "See http://bit.ly/q9",
        "Report: https://www.zerodha.com/reports/may",
        "No links at all.",
        "At http://zerodhaa-safe.xyz/in",
    )
    assert got[0]["suspicious_tld"] and got[0]["impersonation_keyword_count"] == 3
    assert got[1]["is_ip_address"] and not got[1]["has_https"]
    assert got[2]["is_shortened"]
    clean = got[3]
    assert clean["has_https"] and not (clean["suspicious_tld"] or clean["is_ip_address"] or clean["is_shortened"])
    assert got[4]["num_urls"] == 0 and got[4]["has_https"] and not got[4]["is_ip_address"]
    assert got[5]["is_typosquat"]


@pytest.mark.parametrize("domain, squat", [
    ("nseindia.com", True), ("bseindia.com", True), ("zerodha.com", False), ("zerodha.xyz", False),
    ("web.com", True), ("zerodhakyc.top", False), ("zerodha-secure.xyz", True), ("sebl.gov.in", True),
])
def test_typosquat_rule(spark, domain, squat):
    df = spark.createDataFrame([(domain,)], "d string")
    assert df.select(U.is_typosquat(F.col("d")).alias("s")).first()["s"] is squat


def test_typosquat_can_skip_known_domains(spark):
    df = spark.createDataFrame([("nseindia.com",)], "d string")
    assert df.select(U.is_typosquat(F.col("d"), skip_known=True).alias("s")).first()["s"] is False


HOSTS = [
    ("https://login.secure.paytm.phish.co.in:8443/x", "login.secure.paytm", "phish", "co.in"),
    ("http://user:pw@www.example.co.uk/a", "www", "example", "co.uk"),
    ("www.Foo.COM", "www", "foo", "com"),
    ("http://127.0.0.1/", "", "127.0.0.1", ""),
    ("http://999.1.1.1/", "999.1.1", "1", ""),
    ("http://localhost:80", "", "localhost", ""),
    ("http://a.b.c.", "a", "b", "c"),
    ("co.in", "", "", "co.in"),
]


def domain_parts(spark, urls, suffixes=None):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").withColumn(
        "host", host_of(F.col("url")))
    return U.with_stages(df, suffix_stages(suffixes)).orderBy("i").collect()


def test_domain_parts(spark):
    got = [(r["subdomain"], r["domain"], r["suffix"]) for r in domain_parts(spark, [h[0] for h in HOSTS])]
    expected = [h[1:] for h in HOSTS]
    expected[-1] = got[-1]  # a bare suffix is covered below
    assert got == expected


def test_explicit_suffix_list(spark):
    rows = domain_parts(spark, ["http://x.foo.custom.zone/", "http://foo.unlisted/"], ["zone", "custom.zone"])
    assert [(r["domain"], r["suffix"]) for r in rows] == [("foo", "custom.zone"), ("unlisted", "")]


def test_both_domain_rules_agree(spark):
    hosts = [h[0] for h in HOSTS] + ["http://a.gov.in", "http://x.y.com.au", "http://in", "http://1.2", "http://zerоdha.com"]
    df = spark.createDataFrame([(u,) for u in hosts], "url string").withColumn("host", host_of(F.col("url")))
    for r in U.with_stages(df, suffix_stages()).withColumn("short", registrable(F.col("host"))).collect():
        assert r["short"] == r["full_domain"], r["host"]


_URL_TEXT = st.text(alphabet="abz.-/?#;=%@:1", min_size=0, max_size=20)


@settings(max_examples=5, deadline=None)
@given(st.lists(_URL_TEXT, min_size=40, max_size=40))
def test_path_matches_the_standard_parser(spark, tails):
    urls = ["http://host" + t for t in tails] + ["www.h" + t for t in tails]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for r in df.select("url", U.path_of(F.col("url")).alias("path")).collect():
        u = r["url"]
        assert r["path"] == urlparse(u if "://" in u else "http://" + u).path, u


def test_exploded_rows_give_the_same_summary(spark):
    bodies = [
        (1, "http://a.xyz/b https://www.groww.in/x?e=a%40b.c and www.sebi-kyc.in//z"),
        (2, "http://bit.ly/1"), (3, "none"),
    ]
    df = spark.createDataFrame(bodies, "mail_id int, body string")
    in_row = with_url_summary(df, "body").filter("num_urls > 0")
    rows = aggregate_url_rows(U.with_url_features(explode_urls(df, "body", "mail_id")), "mail_id")
    assert sorted(map(str, in_row.select(*rows.columns).collect())) == sorted(map(str, rows.collect()))


def test_summary_of_one_url_is_that_url(spark):
    df = spark.createDataFrame([(1, "go https://sebi.gov.in@x.top:1/a//b?q=%20")], "mail_id int, body string")
    one = U.with_url_features(explode_urls(df, "body", "mail_id")).first()
    total = with_url_summary(df, "body").first()
    for n in U.NUMERIC_FEATURES + U.BOOLEAN_FEATURES + ["has_https"]:
        assert one[n] == total[n], n


def test_hostile_texts_take_linear_time(spark):
    """Long runs that would make a backtracking search quadratic."""
    n = 200_000
    bodies = ["http://" + "a" * n, "http://x/" + ";" * n + "/", "http://" + "a." * n, "http://a." + "b" * n + ".c",
              "http://x/" + "a%" * n, "http://x/?" + "email=" * 2000, " " * n + "x" + "\t" * n, "." * n, "a@" * n,
              "http://h/" + "@" * n]
    mails = [(i, b, "From: " + b + "\n\nx") for i, b in enumerate(bodies)]
    df = spark.createDataFrame(mails, "mail_id int, body_text string, raw_email_source string").repartition(8)
    start = time.monotonic()
    assert mail_features(df, keep=("mail_id",)).count() == len(bodies)
    rows = mail_features(df, keep=("mail_id",)).select("mail_id", "url__url_length", "header__num_attachments", "text__word_count").collect()
    assert {r["mail_id"]: r["url__url_length"] for r in rows}[0] == n + 7
    assert time.monotonic() - start < 60


def test_lookalikes_of_a_registry_equal_brute_force(spark):
    r = random.Random(12)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    brands = [word(r.randrange(1, 9)) for _ in range(60)] + ["a-b", ""]
    hosts = [f"{word(r.randrange(0, 10))}{r.choice(['', '-', '-x-'])}{word(r.randrange(0, 5))}" for _ in range(300)] + brands + ["z" * 40, "-", "b-a"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def squat(base):
        return any(b and b != base and w and distance(w, b) <= 2 for b in brands for w in {*base.split("-"), base})

    domains = spark.createDataFrame([(h + ".com",) for h in hosts] + [(None,)], "full_domain string")
    registry = spark.createDataFrame([(b + ".in",) for b in brands] + [(None,)], "domain string")
    got = {x["full_domain"]: x["is_typosquat"] for x in flag_lookalikes(domains, registry).collect()}
    assert got == {**{h + ".com": squat(h) for h in hosts}, None: False}
    assert not any(x["is_typosquat"] for x in flag_lookalikes(domains, registry.limit(0)).collect())
    plan = flag_lookalikes(domains, registry)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan


def test_suffix_rules_of_all_kinds(spark):
    rules = spark.createDataFrame([("com",), ("uk",), ("co.uk",), ("*.ck",), ("!www.ck",), ("CO.UK",)], "rule string")
    want = {"a.b.com": ("a", "b", "com"), "x.co.uk": ("", "x", "co.uk"), "co.uk": ("", "", "co.uk"), "a.b.ck": ("", "a", "b.ck"), "b.ck": ("", "", "b.ck"),
            "m.www.ck": ("m", "www", "ck"), "www.ck": ("", "www", "ck"), "ck": ("", "", "ck"), "q.unknown": ("", "q", "unknown"), "10.0.0.1": ("", "10.0.0.1", "")}
    rows = with_registrable(spark.createDataFrame([(h,) for h in [*want, None]], "host string"), rules).collect()
    got = {r["host"]: (r["subdomain"], r["domain"], r["suffix"]) for r in rows}
    assert got.pop(None) == (None, None, None) and got == want
