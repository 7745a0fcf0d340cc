import hashlib

import pytest
from pyspark.sql import functions as F

from baitwatch.functions.signatures import content_hash, signature_valid
from baitwatch.operators import registry as R

from rsa import Key

ENTITY = ("id long, entity_name string, entity_type string, registration_number string, public_key_pem string, "
          "status string, authorized_by_id long")


@pytest.fixture(scope="module")
def keys():
    return Key(1), Key(2)


@pytest.fixture(scope="module")
def entities(spark, keys):
    return spark.createDataFrame([
        (1, "Regulator", "regulator", None, keys[0].pem, "active", None),
        (2, "Broker", "broker", "INZ1", keys[1].pem, "active", 1),
        (3, "Gone", "broker", None, keys[1].pem, "revoked", 1),
        (4, "Broken key", "other", None, "-----BEGIN PUBLIC KEY-----\nAAAA\n-----END PUBLIC KEY-----", "active", 1),
    ], ENTITY)


def rows(df, key):
    return {r[key]: r for r in df.collect()}


def test_domains(spark, entities):
    domains = spark.createDataFrame([(1, "reg.example"), (3, "gone.example")], "entity_id long, domain string")
    claims = spark.createDataFrame([(1, " REG.example\t"), (2, "gone.example"), (3, "else.example"), (4, None)], "c int, domain string")
    got = rows(R.verify_domains(claims, domains, entities), "c")
    assert got[1]["verified"] and got[1]["entity_name"] == "Regulator" and got[1]["domain_checked"] == "reg.example"
    assert not got[2]["verified"] and got[2]["entity_name"] == "Gone" and got[2]["status"] == "revoked"
    assert not got[3]["verified"] and got[3]["entity_name"] is None
    assert got[4]["verified"] is False


def test_handles_and_phones(spark, entities):
    handles = spark.createDataFrame([(2, "twitter", "brokerco")], "entity_id long, platform string, handle string")
    claims = spark.createDataFrame([(1, " Twitter", "@@BrokerCo "), (2, "twitter", " @brokerco"), (3, "telegram", "brokerco")],
                                   "c int, platform string, handle string")
    got = rows(R.verify_handles(claims, handles, entities), "c")
    assert [got[i]["verified"] for i in (1, 2, 3)] == [True, False, False]
    phones = spark.createDataFrame([(2, "+91 1")], "entity_id long, phone_number string")
    got = rows(R.verify_phones(spark.createDataFrame([(1, "+91 1\n"), (2, "+91 2")], "c int, phone_number string"), phones, entities), "c")
    assert got[1]["verified"] and not got[2]["verified"]


def test_executives_ignore_status(spark, entities):
    execs = spark.createDataFrame([(3, "A B"), (2, "C D"), (1, "C D")], "entity_id long, executive_name string")
    claims = spark.createDataFrame([(1, " A B "), (2, "a b"), (3, "C D"), (4, None), (5, ""), (6, " ")], "c int, claimed_speaker_name string")
    got = {k: r["executive_authorized"] for k, r in rows(R.verify_executives(claims, execs, entities), "c").items()}
    assert got == {1: True, 2: False, 3: True, 4: None, 5: None, 6: False}
    assert rows(R.verify_executives(claims, execs, entities), "c")[3]["executive_entity"] == "Regulator"


def test_hash_strips(spark):
    df = spark.createDataFrame([("same text",), ("  same text \n",)], "t string")
    got = {r[0] for r in df.select(content_hash(F.col("t"))).collect()}
    assert got == {hashlib.sha256(b"same text").hexdigest()}


def test_signatures(spark, keys):
    a, b = keys
    text = "hello investors"
    cases = [
        (a.pem, text, a.sign(text), True), (a.pem, "tampered", a.sign(text), False), (b.pem, text, a.sign(text), False),
        (a.pem, text, a.sign(text, salt_len=32), False), (a.pem, text, "AAAA", False), (a.pem, text, "not base64!", False),
        ("garbage", text, a.sign(text), False), (None, text, a.sign(text), False), (a.pem, " hello investors\n", a.sign(text), True),
        (b.pem, text, b.sign(text), True),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, p string, t string, s string")
    got = df.select("i", signature_valid(F.col("p"), content_hash(F.col("t")), F.col("s")).alias("ok")).orderBy("i").collect()
    assert [r["ok"] for r in got] == [c[3] for c in cases]


def test_token_and_content(spark, entities, keys):
    sent = spark.createDataFrame([
        (1, "t1", "Trading halted.", keys[0].sign("Trading halted."), "sms", "s"),
        (3, "t3", "x", keys[1].sign("x"), "email", None), (2, "t2", "y", keys[0].sign("y"), "email", None),
    ], "entity_id long, verification_token string, content string, signature_b64 string, channel string, subject string"
    ).withColumn("content_hash", content_hash(F.col("content"))).drop("content")
    claims = spark.createDataFrame([(1, "t1", " Trading halted. "), (2, "t1", "Trading resumed."), (3, "t3", "x"),
                                    (4, "none", "x"), (5, "t2", "y")], "c int, token string, content string")
    got = {k: (r["verified"], r["reason"]) for k, r in rows(R.verify_token_contents(claims, sent, entities), "c").items()}
    assert got == {1: (True, None), 2: (False, "content_tampered"), 3: (False, "entity_revoked"),
                   4: (False, "unknown_token"), 5: (False, "signature_mismatch")}
    found = rows(R.lookup_tokens(claims, sent, entities, base_url="https://x.example/"), "c")
    assert set(found) == {1, 2, 3, 5} and found[1]["currently_valid"] and not found[3]["currently_valid"]
    assert found[1]["link"] == "https://x.example/v/t1"


def test_signed_content_of_an_entity(spark, entities, keys):
    claims = spark.createDataFrame([
        (1, 1, "A's message", keys[0].sign("A's message")), (2, 2, "A's message", keys[0].sign("A's message")),
        (3, 3, "m", keys[1].sign("m")), (4, 77, "m", "x"), (5, 4, "m", keys[0].sign("m")),
    ], "c int, entity_id long, content string, signature_b64 string")
    got = {k: (r["verified"], r["reason"]) for k, r in rows(R.verify_signed_contents(claims, entities), "c").items()}
    assert got == {1: (True, None), 2: (False, "signature_mismatch"), 3: (False, "entity_revoked"),
                   4: (False, "unknown_entity"), 5: (False, "signature_mismatch")}


def test_enrolment_first_owner_wins(spark, entities):
    old = spark.createDataFrame([(1, "reg.example")], "entity_id long, domain string")
    new = spark.createDataFrame([(2, " Reg.example", 1), (2, "new.example", 2), (3, "NEW.example ", 3)],
                                "entity_id long, domain string, arrival long")
    got = {r["domain"]: r["entity_id"] for r in R.add_domains(old, new).collect()}
    assert got == {"reg.example": 1, "new.example": 2}
    execs = R.add_executives(spark.createDataFrame([(1, "A")], "entity_id long, executive_name string"),
                             spark.createDataFrame([(1, " A ", 1), (2, "A", 2)], "entity_id long, executive_name string, arrival long"))
    assert sorted(map(tuple, execs.collect())) == [(1, "A"), (2, "A")]
    assert R.registry_violations(execs, "executive_name").first()["n_rows"] == 2


def test_revocation_is_counted_once(spark, entities):
    listed = spark.createDataFrame([(2,), (2,), (3,), (50,)], "entity_id long")
    once = R.revoke_entities(entities, listed, F.lit("2026-01-01").cast("timestamp"))
    got = rows(once, "id")
    assert [got[i]["changed"] for i in (1, 2, 3, 4)] == [False, True, False, False]
    assert got[2]["status"] == "revoked" and got[2]["revoked_at"] is not None and got[1]["status"] == "active"
    again = rows(R.revoke_entities(once, listed, F.lit("2027-01-01").cast("timestamp")), "id")
    assert not again[2]["changed"] and again[2]["revoked_at"] == got[2]["revoked_at"]


def test_seed_is_idempotent(spark, entities):
    known = spark.createDataFrame([(1, "Regulator", ["reg.example"]), (2, "Exchange", ["ex.example", "ex2.example"]), (3, "New", ["n.example"])],
                                  "request_no long, entity_name string, domains array<string>")
    domains = spark.createDataFrame([(1, "reg.example"), (9, "ex2.example")], "entity_id long, domain string")
    got = rows(R.seed_requests(known, domains, entities, "Regulator"), "entity_name")
    assert set(got) == {"New"} and got["New"]["authorized_by_id"] == 1 and got["New"]["id"] == 7
    empty = entities.limit(0)
    fresh = rows(R.seed_requests(known, domains.limit(0), empty, "Regulator"), "entity_name")
    assert {k: (r["id"], r["authorized_by_id"]) for k, r in fresh.items()} == {
        "Regulator": (1, None), "Exchange": (2, 1), "New": (3, 1)}


def test_checks_build_their_plan_without_jobs_or_hints(spark, entities):
    domains = spark.createDataFrame([(1, "reg.example")], "entity_id long, domain string")
    claims = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.lit("reg.example")).otherwise(F.lit("x")).alias("domain"))
    spark.sparkContext.setJobGroup("checks", "checks")
    out = R.verify_domains(claims, domains, entities)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("checks")
    spark.sparkContext.setJobGroup("tests", "tests")
    assert "hint" not in out._jdf.queryExecution().logical().toString().lower()
    assert out.filter("verified").count() == 666 and out.count() == 1000


def test_additions_without_a_key_are_no_keys(spark):
    old = spark.createDataFrame([(1, "a.example")], "entity_id long, domain string")
    new = spark.createDataFrame([(2, None, 0), (2, None, 1), (3, " B.example ", 2)], "entity_id long, domain string, arrival long")
    assert sorted(map(tuple, R.add_domains(old, new).collect())) == [(1, "a.example"), (3, "b.example")]


def test_every_kind_of_key_keeps_its_first_owner(spark):
    old = spark.createDataFrame([(1, "+1")], "entity_id long, phone_number string")
    new = spark.createDataFrame([(2, " +1 ", 0), (3, "+2", 1), (4, "+2", 2)], "entity_id long, phone_number string, arrival long")
    assert sorted(map(tuple, R.add_phones(old, new).collect())) == [(1, "+1"), (3, "+2")]
    old = spark.createDataFrame([(1, "x", "one")], "entity_id long, platform string, handle string")
    new = spark.createDataFrame([(2, " X", "@One ", 0), (3, "y", "one", 1)], "entity_id long, platform string, handle string, arrival long")
    assert sorted(map(tuple, R.add_handles(old, new).collect())) == [(1, "x", "one"), (3, "y", "one")]
    old = spark.createDataFrame([(1, "Ana")], "entity_id long, executive_name string")
    new = spark.createDataFrame([(2, " Ana ", 0), (1, "Ana", 1)], "entity_id long, executive_name string, arrival long")
    assert sorted(map(tuple, R.add_executives(old, new).collect())) == [(1, "Ana"), (2, "Ana")]


def test_registry_tables_round_trip_and_rules(spark, tmp_path):
    from baitwatch.sources import registry_tables as T

    tables = {
        "entities": spark.createDataFrame([(1, "One", "broker", "PEM", "active"), (1, "Two", "broker", "PEM", "gone")],
                                          "id long, entity_name string, entity_type string, public_key_pem string, status string"),
        "entity_domains": spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "entity_id long, domain string")}
    for name in T.SCHEMAS:
        tables.setdefault(name, spark.createDataFrame([], T.SCHEMAS[name]))
    T.save_registry(tables, str(tmp_path))
    loaded = T.load_registry(spark, str(tmp_path))
    assert set(loaded) == set(T.SCHEMAS) and loaded["entities"].count() == 2
    assert loaded["entities"].columns[-1] == "revoked_at"
    got = {(r["table_name"], r["rule"]): r["n_rows"] for r in T.violations(loaded).collect()}
    assert got == {("entities", "id repeats"): 2, ("entities", "status is unknown"): 1,
                   ("entity_domains", "domain is null"): 1, ("entity_domains", "domain repeats"): 2}
