"""Inputs derived from the driver tables.

Each text below is SQL that Spark and DuckDB read alike, so both engines score
the same rows. ``{table}`` stands for a driver table. Whole tables and whole
texts are used; ``%`` only varies the injected signals from row to row."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..session import deal_out, spread

# Two public test keys and their signatures of one notice. The private
# keys were made for this and thrown away.
NOTICE = "Units are redeemed on the last Friday of the month."
PUBLIC_KEYS = ((
    "-----BEGIN PUBLIC KEY-----\n"
    "MIGfMA0GCSqGSIb3DQEBAQUAA4GNADCBiQKBgQDr0KxRGJWgfPTAiRt0gtnOPwKcd9CBKIfg4PxQ\n"
    "ChmoMRrr3LNmiuQqo6OLCcBvsNzVv9C6zlxQTjN1HktqRQZKKi1ogz/yPzF4rClzBCqgS1BXWPxJ\n"
    "UB1ow+SMgYZOO1g0leuZJyJXYsmk43v9h547+HSVr1nOg3k2el1uERSIjQIDAQAB\n"
    "-----END PUBLIC KEY-----\n"
), (
    "-----BEGIN PUBLIC KEY-----\n"
    "MIGfMA0GCSqGSIb3DQEBAQUAA4GNADCBiQKBgQCfHGNVLtdN2ordSvf+TY6URVEhQPzOk7dzD1eS\n"
    "LM24SB/ba8mtsrdKoBHlWNd9r2jylw67PlOSS0QaeVhU93Xz87y5MpJ/Gfq65Nm60XNHS3cT0ecR\n"
    "SrbuISZiPVEWpCE6nnh8V42jSfrFwsFWi0QjB7ID91gN4KEv13NwJ+Fx4QIDAQAB\n"
    "-----END PUBLIC KEY-----\n"
))
SIGNATURES = ((
    "Ge9TSZCpbBHfWRBbCfAN41QjdWJzT+xT1IlMp64FazGZCdGj9mpCVCSaT3aVRtzUE7QHA+UWBiEeu1EISmA0J7qhm9BS7Vk0zRo2"
    "Oro9GhpRYtVsCf+eFg9rAGlDMQcoNJJxQs6JE2X0PdkzXPkcoKc6aFfkZt4pAhzn0u7TNpE="
), (
    "c++8Ey67niYd2mYRlWXZ2C9JdFdkjmQrU3/iVoEuraxfs+3rukV8R7L1GrPOR1kgu0vHtLYMxanKg/EEBDt1f/kTGp+Ne90bO+VL"
    "mhnqmsrzXkuOR+2wBBwi00Kg74/epYzJQVCgxAqptQeBHDl30pGlvA2/6Vn8hdnnQNJEXPo="
))

# Senders in the order of the fixed list, by document.
_KNOWN = list(lx.KNOWN_ENTITY_DOMAINS.items())
_ENTITY = f"CASE doc_id % {len(_KNOWN)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, (_, n) in enumerate(_KNOWN)) + " END"
_ENTITY_DOMAIN = f"CASE doc_id % {len(_KNOWN)} " + " ".join(f"WHEN {i} THEN '{d}'" for i, (d, _) in enumerate(_KNOWN)) + " END"

# One text feature after the other, then texts that combine two, then plain ones.
_SIGNAL = """CASE doc_id % 11
    WHEN 0 THEN 'Ship it asap, the deadline is near, and wire the funds as well.'
    WHEN 1 THEN 'Noticed you at the fair; your hobby came up, your family too. A reimbursement is open.'
    WHEN 2 THEN 'As a large language model I answer: i cannot assist with that.'
    WHEN 3 THEN 'Limited connectivity here, in a meeting all day. We write through this email only.'
    WHEN 4 THEN 'At your earliest convenience let us foster a holistic realm; it is paramount and innovative.'
    WHEN 5 THEN 'Closed given that it rained, as a result of which, in order to dry, we waited.'
    WHEN 6 THEN 'Yes. Ms. Lind of Fjord Inc. and Mrs. Ek e.g. will come along on Sunday for the long walk!  Or not?'
    WHEN 7 THEN 'To ' || chr(123) || chr(123) || 'first' || chr(125) || chr(125)
        || ' [insert recipient], unable to confirm via phone; gift card and pin number enclosed.'
    WHEN 8 THEN 'Bye.'
    WHEN 9 THEN 'They can' || chr(39) || 't answer calls. Your trip looked fine! I wanted to reach out in today'
        || chr(39) || 's rapidly evolving myriad.'
    ELSE 'Red hens lay eggs. Red hens lay eggs. Red hens lay eggs.' END"""

_LINKS = """CASE doc_id % 12
    WHEN 0 THEN 'No link here.'
    WHEN 1 THEN 'Form: http://' || brand || '-desk-login.ml/broker/' || doc_id || '/refund'
    WHEN 2 THEN 'Login: http://192.168.1.' || (doc_id % 256) || '/login'
    WHEN 3 THEN 'Claim http://bit.ly/a' || doc_id || ' or www.' || ent_domain || '/help;v=1?x=2'
    WHEN 4 THEN 'See https://www.' || ent_domain || '/console/statements'
    WHEN 5 THEN 'Go https://kotaksecuritles.ga/open?who=reader%40example.org'
    WHEN 6 THEN 'Go https://groww.in@pay.angelonee.tk:9443/a//b#c'
    WHEN 7 THEN 'Read https://WWW.CdslIndia.COM/Path/To'
    WHEN 8 THEN 'Read https://zerоdha.com/login'
    WHEN 9 THEN '<a href="http://one.two.icicldirect.online/x/y%20z">pay</a> https://help.' || ent_domain || '/faq'
    WHEN 10 THEN 'Read https://mail.example.co.in/u/john.doe@mail.com/inbox'
    ELSE 'Admin http://localhost:8080/admin and http://999.1.2.3/x' END"""

_FROM = """CASE doc_id % 10
    WHEN 0 THEN 'From: "Regulator of ' || ent || '" <office77@yandex.com>' || chr(10)
    WHEN 1 THEN 'From: "' || ent || ' Exchange" <post@' || ent_domain || '>' || chr(10)
    WHEN 2 THEN 'From: info@nsdl.co.in' || chr(10)
    WHEN 3 THEN 'From: Security Team <team@eu.angelone.co.in>' || chr(10)
    WHEN 4 THEN ''
    WHEN 5 THEN 'From: "Compliance' || chr(10) || chr(9) || 'Board" <c.b@aol.com>' || chr(10)
    WHEN 6 THEN 'From: robot@cdslindia.com (CDSL robot)' || chr(10)
    WHEN 7 THEN 'FROM: KYC Room <Room9@ICloud.COM>' || chr(10)
    WHEN 8 THEN 'From: "Ek, Pia" <pia@' || brand || '-room.ga>' || chr(10)
    ELSE 'From: x@groww.in, y@groww.in' || chr(10) END"""
_REPLY_TO = """CASE doc_id % 4 WHEN 0 THEN 'Reply-To: desk@gmail.com' || chr(10)
    WHEN 1 THEN 'Reply-To: help@' || ent_domain || chr(10)
    WHEN 2 THEN '' ELSE 'Reply-to: <help@' || ent_domain || '>' || chr(10) END"""
_RETURN_PATH = """CASE doc_id % 3 WHEN 0 THEN 'Return-Path: <list-17@relay.example.org>' || chr(10)
    WHEN 1 THEN 'Return-Path: <list-17@' || ent_domain || '>' || chr(10)
    ELSE 'Return-Path: <>' || chr(10) END"""
_SENDER = """CASE doc_id % 5 WHEN 0 THEN 'Sender: <bulk@mailer.example.org>' || chr(10)
    WHEN 1 THEN 'Sender: "Bulk" <bulk@' || ent_domain || '>' || chr(10) ELSE '' END"""
_AUTH = """CASE doc_id % 6
    WHEN 0 THEN 'Authentication-Results: mx.example.com; spf=fail; dkim=none; dmarc=fail' || chr(10)
    WHEN 1 THEN 'Authentication-Results: mx.example.com; spf=pass; dkim=pass; dmarc=pass' || chr(10)
    WHEN 2 THEN 'Authentication-Results: mx.example.com; spf=softfail; dkim=fail; dmarc=fail' || chr(10)
    WHEN 3 THEN 'Received-SPF: SoftFail (mx.example.com: not designated)' || chr(10)
    WHEN 4 THEN ''
    ELSE 'Authentication-Results: mx.example.com;' || chr(10) || chr(9) || 'SPF=neutral'
        || chr(10) || ' dkim=pass; dmarc=pass' || chr(10) END"""
_MESSAGE_ID = """CASE doc_id % 5 WHEN 0 THEN 'Message-ID: <1234@localhost>' || chr(10)
    WHEN 1 THEN 'Message-Id: <a1.' || doc_id || '@mail.' || ent_domain || '>' || chr(10)
    WHEN 2 THEN '' WHEN 3 THEN 'Message-ID: garbage' || chr(10)
    ELSE 'Message-ID: <x@other.example.net>' || chr(10) END"""
_MAILER = """CASE doc_id % 6 WHEN 0 THEN 'X-Mailer: PHPMailer 6.5' || chr(10)
    WHEN 1 THEN 'X-Mailer: Microsoft Outlook 16.0' || chr(10)
    WHEN 2 THEN 'User-Agent: python-smtplib/3' || chr(10)
    WHEN 3 THEN 'X-Mailer: Outlook Express 6' || chr(10)
    WHEN 4 THEN 'X-Mailer: ' || chr(10) || 'User-Agent: SwiftMailer' || chr(10) ELSE '' END"""
_FILE = """CASE doc_id % 5 WHEN 0 THEN 'invoice.pdf.exe' WHEN 1 THEN 'Statement.DOCM'
    WHEN 2 THEN 'photo.jpg' WHEN 3 THEN 'KYC-verify.js' ELSE 'report.tar.gz' END"""

MAIL = f"""
SELECT doc_id AS mail_id,
    CAST(CASE WHEN (doc_id * 7919) % 100 < 7 THEN 1 - doc_id % 2 ELSE doc_id % 2 END AS INT) AS label,
    'tpl_' || (doc_id % 7) AS template_id, 'Category ' || (doc_id % 7) AS category,
    subject, body_text,
    CASE WHEN doc_id % 13 = 0 THEN replace(raw, chr(10), chr(13) || chr(10)) ELSE raw END
        AS raw_email_source,
    'derived from ' || source AS notes
FROM (
  SELECT *, head || CASE WHEN doc_id % 6 = 1 THEN
      'Content-Type: multipart/mixed; boundary="b1"' || chr(10) || chr(10)
      || '--b1' || chr(10) || 'Content-Type: text/plain' || chr(10) || chr(10) || body_text || chr(10)
      || '--b1' || chr(10) || 'Content-Type: application/octet-stream' || chr(10)
      || 'Content-Disposition: attachment; filename="' || file_name || '"' || chr(10) || chr(10)
      || 'AAAA' || chr(10)
      || CASE WHEN doc_id % 4 = 1 THEN '--b1' || chr(10) || 'Content-Disposition: attachment; filename="readme"'
          || chr(10) || chr(10) || 'B' || chr(10) ELSE '' END
      || '--b1--' || chr(10)
    ELSE chr(10) || body_text || chr(10) END AS raw
  FROM (
    SELECT *, text || chr(10) || {_SIGNAL} || ' ' || {_LINKS} AS body_text,
      {_FILE} AS file_name,
      'Action required: case ' || doc_id AS subject,
      repeat('Received: from relay.example.net by mx.example.com;' || chr(10) || chr(9)
          || 'Tue, 08 Jul 2025 10:00:00 +0000' || chr(10), CAST(doc_id % 4 AS INT))
      || {_FROM} || 'To: investor@example.com' || chr(10) || {_REPLY_TO} || {_RETURN_PATH} || {_SENDER}
      || 'Subject: Action required: case ' || doc_id || chr(10) || {_MESSAGE_ID} || {_MAILER}
      || CASE WHEN doc_id % 8 = 0 THEN 'X-PHP-Originating-Script: 1000:mailer.php' || chr(10) ELSE '' END
      || {_AUTH} || 'Date: Tue, 08 Jul 2025 10:00:00 +0000' || chr(10) AS head
    FROM (
      SELECT *, {_ENTITY} AS ent, {_ENTITY_DOMAIN} AS ent_domain,
        CASE doc_id % 9 WHEN 0 THEN 'sebi' WHEN 1 THEN 'zerodha' WHEN 2 THEN 'groww' ELSE 'nse' END AS brand
      FROM {{documents}}
    ) AS d1
  ) AS d2
) AS d3"""

# Mails whose headers are only partly known, as a flat table.
PARTIAL = """
SELECT conv_id * 1000 + turn AS row_id,
    CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '"Desk" <desk@example.net>' ELSE 'u' || conv_id || '@example.org' END AS sender,
    CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN ' a@example.com , b@example.com' ELSE 'c@example.com' END AS receiver,
    CASE conv_id % 5 WHEN 0 THEN NULL ELSE 'Tue, 01 Jul 2025 00:00:00 +0000' END AS date,
    CASE conv_id % 3 WHEN 0 THEN NULL ELSE 'Turn ' || turn END AS subject,
    CASE (conv_id + turn) % 17 WHEN 0 THEN NULL WHEN 1 THEN '  short ' || chr(9) ELSE text END AS body,
    CAST(conv_id % 2 AS INT) AS label
FROM {conversations}"""

PREDICTION = """
SELECT doc_id AS mail_id, CAST(doc_id % 2 AS INT) AS label,
    CAST(CASE WHEN doc_id % 10 = 0 THEN 1 - doc_id % 2 ELSE doc_id % 2 END AS INT) AS prediction,
    ((doc_id * 7919) % 10007) / 10006e0 AS probability
FROM {documents}"""

POST = """
SELECT c.conv_id * 1000 + c.turn AS post_id, c.conv_id % 100 AS user_id,
    c.text || ' ' || CASE (c.conv_id + c.turn) % 7
      WHEN 0 THEN 'It expires soon, so act now and send the payment.'
      WHEN 1 THEN 'Saw that you like hiking. The invoice and kyc are ready.'
      WHEN 2 THEN 'As a large language model. We delve into a robust, seamless tapestry.'
      WHEN 3 THEN 'Limited connectivity, traveling and in a meeting all day.'
      ELSE 'Shares closed mixed today.' END AS post_text,
    CASE (c.conv_id % 100) % 6 WHEN 0 THEN 'n7041996' WHEN 1 THEN 'Account310'
      WHEN 2 THEN 'lakeside' WHEN 3 THEN 'q____r' WHEN 4 THEN NULL ELSE 'user5' END AS handle,
    CASE (c.conv_id % 100) % 4 WHEN 0 THEN 'Forex Signals every day; passive income guru.'
      WHEN 1 THEN 'Paints boats.' WHEN 2 THEN NULL ELSE 'financial FREEDOM for all' END AS bio_text,
    CASE (c.conv_id % 100) % 7 WHEN 0 THEN NULL WHEN 1 THEN 'not-a-date' WHEN 2 THEN '2024-01-20'
      WHEN 3 THEN '2024-02-30' WHEN 4 THEN '2019-03-15' WHEN 5 THEN '2024-01-02' ELSE '2023-12-31' END
      AS account_created_date,
    CASE (c.conv_id % 100) % 5 WHEN 0 THEN NULL ELSE coalesce(e.n_events, 0) / 3e0 END AS posts_per_day,
    CASE (c.conv_id % 100) % 8 WHEN 0 THEN NULL ELSE ((c.conv_id % 100) * 7) % 400 END AS followers,
    CASE (c.conv_id % 100) % 4 WHEN 0 THEN 0 WHEN 1 THEN 3000 WHEN 2 THEN NULL ELSE 400 END AS following,
    CASE c.turn % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS image_applicable,
    CASE c.turn % 3 WHEN 0 THEN NULL ELSE ((c.conv_id * 31) % 101) / 100e0 END AS image_fake_probability
FROM {conversations} AS c
LEFT JOIN (SELECT user_id, count(*) AS n_events FROM {events} GROUP BY user_id) AS e
  ON e.user_id = c.conv_id % 100"""

ENTITY = f"""
SELECT s_suppkey + 1 AS id, s_name AS entity_name,
    CASE s_nationkey % 4 WHEN 0 THEN 'regulator' WHEN 1 THEN 'exchange' WHEN 2 THEN 'broker' ELSE 'other' END AS entity_type,
    CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'INZ' || s_suppkey END AS registration_number,
    CASE s_suppkey % 2 WHEN 0 THEN '{PUBLIC_KEYS[0]}' ELSE '{PUBLIC_KEYS[1]}' END AS public_key_pem,
    CASE WHEN s_suppkey % 7 = 0 THEN 'revoked' ELSE 'active' END AS status,
    CASE WHEN s_suppkey = 0 THEN NULL ELSE 1 END AS authorized_by_id
FROM {{supplier}}"""
ENTITY_DOMAIN = "SELECT s_suppkey + 1 AS entity_id, 's' || s_suppkey || '.example.com' AS domain FROM {supplier}"
ENTITY_PHONE = "SELECT s_suppkey + 1 AS entity_id, '+91-22-' || (4000000 + s_suppkey) AS phone_number FROM {supplier}"
ENTITY_HANDLE = """SELECT s_suppkey + 1 AS entity_id,
    CASE s_suppkey % 2 WHEN 0 THEN 'twitter' ELSE 'telegram' END AS platform,
    'supplier' || s_suppkey AS handle FROM {supplier}"""
ENTITY_EXECUTIVE = "SELECT s_suppkey + 1 AS entity_id, 'Exec ' || (s_suppkey % 40) AS executive_name FROM {supplier}"

# One claim of each kind per order; keys repeat heavily.
CLAIM = """
SELECT o_orderkey AS claim_id,
    CASE o_orderkey % 3 WHEN 0 THEN ' S' || (o_custkey % 1200) || '.Example.com' || chr(9)
      WHEN 1 THEN 's0.example.com' ELSE 's' || (o_custkey % 150) || '.example.com' END AS domain,
    CASE o_orderkey % 2 WHEN 0 THEN ' Twitter' ELSE 'telegram' END AS platform,
    CASE o_orderkey % 5 WHEN 0 THEN '@@Supplier' || (o_custkey % 150) WHEN 1 THEN ' @supplier1'
      ELSE 'SUPPLIER' || (o_custkey % 1200) || ' ' END AS handle,
    CASE o_orderkey % 4 WHEN 0 THEN ' +91-22-' || (4000000 + o_custkey % 150) || chr(10)
      ELSE '+91-22-' || (4000000 + o_custkey % 1500) END AS phone_number,
    CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' Exec ' || (o_custkey % 60)
      WHEN 2 THEN 'exec 1' ELSE 'Exec ' || (o_custkey % 45) END AS claimed_speaker_name
FROM {orders}"""

# Every second turn is the notice, signed by its entity's key or by the other one.
COMMUNICATION = f"""
SELECT conv_id % 90 + 1 AS entity_id, 'tok-' || conv_id || '-' || turn AS verification_token,
    CASE WHEN turn % 2 = 0 THEN '{NOTICE}' ELSE text END AS content, CASE turn % 2 WHEN 0 THEN 'email' ELSE 'sms' END AS channel,
    'Turn ' || turn AS subject,
    CASE WHEN turn % 2 = 1 THEN 'AAAA' WHEN (conv_id % 90 + (turn % 4) * 0.5) % 2 = 0 THEN '{SIGNATURES[0]}' ELSE '{SIGNATURES[1]}' END AS signature_b64
FROM {{conversations}}"""
TOKEN_CLAIM = f"""
SELECT conv_id * 1000 + turn AS claim_id,
    CASE WHEN (conv_id + turn) % 11 = 0 THEN 'missing-' || conv_id ELSE 'tok-' || conv_id || '-' || turn END AS token,
    CASE WHEN (conv_id + turn) % 5 = 0 THEN text || ' altered' WHEN turn % 2 = 0 THEN '{NOTICE}'
      ELSE '  ' || text || chr(10) END AS content
FROM {{conversations}}"""

MEDIA = "SELECT c_custkey AS media_id, c_custkey AS incident_id FROM {customer}"
MEDIA_UNIT = """
SELECT user_id AS media_id, event_id AS unit_no,
    least(1.0, value / 500.0 + (user_id % 3) * 0.35) AS fake_probability
FROM {events}"""
UNIT_PROBABILITY = """
SELECT event_id AS unit_id, CASE event_id % 4 WHEN 0 THEN 'fake' WHEN 1 THEN 'Spoof' WHEN 2 THEN 'LABEL_1' ELSE 'Fake' END AS second_label,
    CASE event_id % 4 WHEN 2 THEN 'LABEL_0' ELSE 'real' END AS first_label,
    (event_id % 1000) / 1000e0 AS p_first, 1e0 - (event_id % 1000) / 1000e0 AS p_second
FROM {events}"""
FRAME = "SELECT l_orderkey AS media_id, l_linenumber AS line_no, l_partkey AS frame_index FROM {lineitem}"
FACE_BOX = """
SELECT l_orderkey AS media_id, l_linenumber AS line_no, l_partkey AS frame_index,
    l_quantity * 12.5 - 20.0 AS x1, l_discount * 4000.0 - 30.0 AS y1,
    l_quantity * 12.5 - 20.0 + l_tax * 2000.0 AS x2,
    l_discount * 4000.0 - 30.0 + l_linenumber * 25.25 AS y2,
    640 AS frame_width, 480 AS frame_height
FROM {lineitem}"""
CLIP = "SELECT o_orderkey AS media_id, CAST(o_orderkey % 3 AS BIGINT) * CAST(floor(o_totalprice) AS BIGINT) AS total_samples FROM {orders}"
UPLOAD = """
SELECT p_partkey AS upload_id,
    'in/' || replace(p_name, ' ', '_') || '.' || CASE p_partkey % 8 WHEN 0 THEN 'MP4' WHEN 1 THEN 'wav'
      WHEN 2 THEN 'jpg' WHEN 3 THEN 'exe' WHEN 4 THEN 'webm' WHEN 5 THEN 'flac' WHEN 6 THEN 'v1.png' ELSE 'mov' END AS path,
    CASE p_partkey % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'image' END AS kind,
    CAST(p_size AS BIGINT) * 6000000 AS length
FROM {part}"""

FIXTURES = {
    "mail": MAIL, "partial": PARTIAL, "prediction": PREDICTION, "post": POST,
    "entity": ENTITY, "entity_domain": ENTITY_DOMAIN, "entity_phone": ENTITY_PHONE,
    "entity_handle": ENTITY_HANDLE, "entity_executive": ENTITY_EXECUTIVE, "claim": CLAIM,
    "communication": COMMUNICATION, "token_claim": TOKEN_CLAIM, "media": MEDIA,
    "media_unit": MEDIA_UNIT, "unit_probability": UNIT_PROBABILITY, "frame": FRAME,
    "face_box": FACE_BOX, "clip": CLIP, "upload": UPLOAD,
}

# Rules of all three kinds for the hosts of the fixtures.
SUFFIX_RULES = ["com", "org", "net", "in", "co.in", "ga", "ml", "tk", "*.example.com", "!www.example.com", "*.online", "!icicldirect.online", "example", "ly"]

TEXT_TABLES = {"documents", "pages", "conversations"}


def rule_nodes(features: list[str]) -> list[tuple]:
    """Boosted trees by rule instead of by fit, a tree per feature: ``(tree, node, weight,
    feature, threshold, left, right, value)``. The tree of the k-th feature (in
    alphabetical order) splits on it, then to the left on the one after it, to the right
    on the one three after it."""
    names, out = sorted(features), []
    for k in range(len(names)):
        second, third = names[(k + 1) % len(names)], names[(k + 3) % len(names)]
        weight = 1.0 if k == 0 else 0.1
        value = lambda j: ((k * 7 + j * 5) % 11 - 5) / 4
        out += [(k, 0, weight, names[k], k % 3 + 0.5, 1, 2, None), (k, 1, weight, second, k % 2 - 0.5, 3, 4, None),
                (k, 2, weight, third, k % 5 + 0.25, 5, 6, None)]
        out += [(k, 3 + j, weight, None, None, None, None, value(j)) for j in range(4)]
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = FIXTURES[name]
    used = set(re.findall(r"\{(\w+)\}", sql))
    # Whole texts are worth dealing out; rows of numbers are not.
    tables = {t: spread(table(spark, sf_dir, t)) if t in TEXT_TABLES else table(spark, sf_dir, t) for t in used}
    return spark.sql(sql, **tables)


def fixture_sql(name: str) -> str:
    """The same rows as a DuckDB sub-query text."""
    return re.sub(r"\{(\w+)\}", r"\1", FIXTURES[name])


def dealt_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mail fixture for steps that work long on each text: documents are dealt out
    before each is written into a mail twice."""
    documents = deal_out(table(spark, sf_dir, "documents"), "doc_id", F.xxhash64("text"))
    return spark.sql(MAIL, documents=documents)
