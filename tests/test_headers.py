from email import message_from_string
from email.utils import parseaddr

from pyspark.sql import functions as F

from baitwatch.functions import headers as H
from baitwatch.functions import mime
from baitwatch.functions import urls as U
from baitwatch.operators.features import with_attachment_features, with_header_features
from baitwatch.operators.registry import verify_senders
from baitwatch.plans.fixtures import fixture
from baitwatch.sources.mail_tables import header_rows

CALM = {
    "From": "Ledger <post@groww.in>", "Reply-To": "post@groww.in", "Return-Path": "<post@groww.in>",
    "Message-ID": "<k3@groww.in>", "User-Agent": "Evolution 3.50",
    "Authentication-Results": "in.example.org; spf=pass; dkim=pass; dmarc=pass",
}
# One header changed per branch, the flag it must raise, and nothing else asserted.
BRANCHES = [
    ("From", "Compliance Room <c9@aol.com>", "display_name_impersonation"),
    ("From", "c9@aol.com", "sender_uses_free_email"),
    ("Reply-To", "other@icloud.com", "reply_to_is_free_email"),
    ("Reply-To", "post@elsewhere.example", "from_replyto_mismatch"),
    ("Return-Path", "<x1@relay.example>", "from_returnpath_mismatch"),
    ("Message-ID", "<9@workstation>", "message_id_domain_mismatch"),
    ("User-Agent", "python-smtplib/3.9", "suspicious_mailer"),
    ("Authentication-Results", "in.example.org; spf=softfail; dkim=none; dmarc=fail", "auth_all_failed"),
]


def message(**changed):
    lines = [f"{k}: {v}" for k, v in {**CALM, **{k.replace("_", "-"): v for k, v in changed.items()}}.items()]
    return "\n".join(lines) + "\n\nLedger of the quarter.\n"


LEGIT = message()
ODD = """Received: from a
\tby b
Received: from c by d
X-PHP-Originating-Script: 33:x.php
reply-to: <a@b.co.in>
Received-SPF: Neutral (x)

body: not a header
"""
NO_BLANK = "Subject: x\nThis line is no header\nFrom: late@x.com\n"
EMPTY = "just text, no header at all"


def features(spark, *raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "mail_id int, raw string")
    df = with_attachment_features(with_header_features(df, "raw"), "raw")
    return {r["mail_id"]: r for r in df.collect()}


def test_each_flag_has_its_branch(spark):
    got = features(spark, LEGIT, *[message(**{name.replace("-", "_"): value}) for name, value, _ in BRANCHES])
    for i, (_, _, flag) in enumerate(BRANCHES, 1):
        assert not got[0][flag], flag
        assert got[i][flag], flag
    assert not any(got[k]["auth_all_failed"] for k in range(len(BRANCHES)))
    assert (got[8]["spf_result"], got[8]["dkim_result"], got[8]["dmarc_result"]) == ("softfail", "none", "fail")
    assert got[0]["num_attachments"] == 0 and not got[0]["has_dangerous_attachment"]


def test_odd_shapes(spark):
    got = features(spark, ODD, NO_BLANK, EMPTY, ODD.replace("\n", "\r\n"))
    odd = got[0]
    assert odd["received_chain_length"] == 2 and odd["has_script_originating_header"]
    assert odd["spf_result"] == "neutral" and not odd["auth_all_failed"]
    assert odd["from_domain"] == "" and odd["from_replyto_mismatch"]
    assert got[1]["from_addr"] == "" and got[2]["received_chain_missing"] and got[2]["auth_all_failed"]
    assert got[3][2:] == odd[2:]


def test_header_reading_matches_the_standard_parser(spark, small):
    raws = fixture(spark, small, "mail").select("mail_id", "raw_email_source")
    names = ["From", "Reply-To", "Return-Path", "Sender", "Message-ID", "X-Mailer", "User-Agent", "Authentication-Results"]
    head = H.header_block(F.col("raw_email_source"))
    extra = spark.createDataFrame(
        [(-1, LEGIT), (-2, ODD), (-3, NO_BLANK), (-4, EMPTY), (-5, "From: a@b.c\nX-Mailer: y")],
        "mail_id long, raw_email_source string")
    got = raws.unionByName(extra).withColumn("head", head).select(
        "raw_email_source", *[H.header(F.col("head"), n).alias(n) for n in names]).collect()
    for r in got:
        message = message_from_string(r["raw_email_source"])
        for n in names:
            assert r[n].split() == message.get(n, "").split(), (n, r["raw_email_source"][:300])


def test_header_rows_match_the_standard_parser(spark, small):
    mails = fixture(spark, small, "mail").select("mail_id", "raw_email_source")
    got = {}
    for r in header_rows(mails).orderBy("mail_id", "pos").collect():
        got.setdefault(r["mail_id"], []).append((r["name"], r["value"].split()))
    for r in mails.collect():
        expected = [(k.lower(), v.split()) for k, v in message_from_string(r["raw_email_source"]).items()]
        assert got[r["mail_id"]] == expected


def test_addresses_match_the_standard_parser(spark):
    values = [
        '"Quay 4" <q4@dock.example>', "Pia Ek <pia@ek.example>", "bare@ek.example",
        "robot@ek.example (a robot)", '"Ek, Pia" <pia@ek.example>', "x@ek.example, y@ek.example", "<>", "",
        "<only@angle.org>", "  spaced@x.com  ", "p@q.example <r@s.example>", "no-at-sign",
        '"A" (note) <c@d.e>', "Name <a@b.c>, Other <d@e.f>",
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, from_raw string")
    for r in U.with_stages(df, H.address_stages("from")).collect():
        name, addr = parseaddr(r["from_raw"])
        assert (r["from_addr"] or "").lower() == addr.lower(), r["from_raw"]
        if "(note)" not in r["from_raw"]:
            assert r["from_name"] == name, r["from_raw"]


def test_sender_check(spark):
    df = spark.createDataFrame([("k@groww.in",), ("x@mail.nsdl.co.in",), ("k@groww-in.ga",),
                                ("k@aol.com",), ("not-an-address",), ("",)], "from_addr string")
    got = {r["from_addr"]: (r["sender_verified"], r["sender_entity"], r["domain_checked"])
           for r in verify_senders(df).collect()}
    assert got["k@groww.in"] == (True, "Groww", "groww.in")
    assert got["x@mail.nsdl.co.in"] == (True, "NSDL", "nsdl.co.in")
    assert got["k@groww-in.ga"] == (False, None, "groww-in.ga")
    assert not got["k@aol.com"][0]
    assert got["not-an-address"] == (False, None, "") == got[""]


MULTIPART = """From: a@b.c
Content-Type: multipart/mixed; boundary="X"

--X
Content-Type: text/html

<p>no</p>
--X
Content-Type: text/plain; charset=utf-8
Content-Transfer-Encoding: quoted-printable

caf=C3=A9 plain
--X
Content-Type: application/octet-stream; name="macro.docm"

AAAA
--X
Content-Disposition: attachment; filename*=utf-8''Invoice%2Epdf%2Eexe

AAAA
--X--
"""
BASE64 = "Content-Transfer-Encoding: base64\n\naGVsbG8gd29ybGQ=\n"


def test_bodies_and_attachments(spark):
    raws = [MULTIPART, LEGIT, BASE64, EMPTY, MULTIPART.replace("text/plain", "text/html"), 'Subject: x\n\nset name= here\n']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    rows = df.select("i", mime.message_body(F.col("raw")).alias("b"),
                     mime.attachment_names(F.col("raw")).alias("f")).orderBy("i").collect()
    assert rows[0]["b"].strip() == "café plain"
    assert rows[1]["b"] == message_from_string(LEGIT).get_payload()
    assert rows[2]["b"] == "hello world" and rows[3]["b"] == EMPTY
    assert rows[4]["b"].strip() == "AAAA"  # a part without a type counts as plain text
    assert [r["f"] for r in rows] == [["macro.docm", "Invoice.pdf.exe"], [], [], [], ["macro.docm", "Invoice.pdf.exe"], []]
    flags = with_attachment_features(df, "raw").orderBy("i").first()
    assert flags["num_attachments"] == 2 and flags["has_macro_attachment"] and flags["has_dangerous_attachment"]
    assert flags["has_double_extension_attachment"] and flags["attachment_social_keyword_count"] == 1
