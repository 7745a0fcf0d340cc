"""Registered queries: ``(spark, sf_dir) -> DataFrame`` over the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions import lexicons as lx
from ..functions import social as S
from ..functions import text as X
from ..functions import urls as U
from ..functions.numbers import round_exact
from ..functions.scoring import decision, risk_tier
from ..functions.signatures import content_hash
from ..operators import dataset as D
from ..operators import features as FE
from ..operators import learn as L
from ..operators import media as M
from ..operators import registry as R
from ..operators import report as RP
from ..operators.ordering import renumber
from ..operators.scan import model_vocabulary, scan_mails
from ..operators.social import scan_posts, with_behaviour
from ..operators.suffixes import with_registrable
from ..operators.trees import Node, load_nodes, node_table, save_nodes
from ..operators.typosquat import flag_lookalikes
from ..operators.urls import aggregate_url_rows, explode_urls
from ..session import ensure_checkpoint_dir, spread
from ..sources import generator as G
from ..sources import mail_tables as MT
from ..sources.uploads import check_uploads
from ..streaming import scans as ST
from .fixtures import SUFFIX_RULES, dealt_mails, fixture, rule_nodes, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- Links ------------------------------------------------------------------


def _mails(spark, sf, *cols: str) -> DataFrame:
    return fixture(spark, sf, "mail").select("mail_id", *cols)


def _all_urls(spark, sf) -> DataFrame:
    """Links of the mails, page addresses, and links inside page sources."""
    pages = spread(table(spark, sf, "pages"))
    mail = explode_urls(_mails(spark, sf, "body_text"), "body_text", "mail_id")
    html = explode_urls(pages, "html", "page_id")
    return reduce(DataFrame.unionByName, [
        mail.select(F.lit("mail").alias("origin"), F.col("mail_id").alias("owner_id"), "pos", "url"),
        pages.select(F.lit("page").alias("origin"), F.col("page_id").alias("owner_id"), F.lit(-1).alias("pos"), "url"),
        html.select(F.lit("page").alias("origin"), F.col("page_id").alias("owner_id"), "pos", "url"),
    ])


_OWNER = ("origin", "owner_id", "pos")


@query
def url_find(spark, sf):
    return explode_urls(_mails(spark, sf, "body_text"), "body_text", "mail_id")


@query
def url_parts(spark, sf):
    urls = U.with_stages(_all_urls(spark, sf), [U.parts_stage])
    return urls.select(*_OWNER, "url", U.scheme_of(F.col("url")).alias("scheme"), "host", "path")


@query
def url_domain(spark, sf):
    urls = U.with_stages(_all_urls(spark, sf), [U.parts_stage, *U.suffix_stages()])
    return urls.select(*_OWNER, "host", "subdomain", "domain", "suffix", "full_domain")


def _url_features(spark, sf) -> DataFrame:
    return U.with_url_features(_all_urls(spark, sf))


@query
def url_domain_rules(spark, sf):
    """Registrable domains under a rule table with wildcards and exceptions."""
    rules = spark.sql("VALUES " + ", ".join(f"('{r}')" for r in SUFFIX_RULES)).toDF("rule")
    hosts = _all_urls(spark, sf).select(*_OWNER, U.host_of(F.col("url")).alias("host"))
    return with_registrable(hosts, rules)


@query
def url_lexical(spark, sf):
    return _url_features(spark, sf).select(
        *_OWNER, "url_length", "num_dots", "num_hyphens", "num_at_symbols", "num_digits",
        "num_percent_encoded_chars", "subdomain_level", "path_level")


@query
def url_flags(spark, sf):
    return _url_features(spark, sf).select(
        *_OWNER, "is_ip_address", "has_https", "is_shortened", "suspicious_tld", "has_at_symbol_trick",
        "has_double_slash_in_path", "has_email_in_url", "has_homograph_chars")


@query
def url_impersonation(spark, sf):
    return _url_features(spark, sf).select(*_OWNER, "impersonation_keyword_count")


@query
def url_typosquat(spark, sf):
    return _url_features(spark, sf).select(*_OWNER, "full_domain", "is_typosquat")


def _registered_domains(spark, sf) -> DataFrame:
    known = ", ".join(f"('{d}')" for d in lx.KNOWN_ENTITY_DOMAINS)
    return fixture(spark, sf, "entity_domain").select("domain").union(spark.sql(f"VALUES {known}"))


@query
def url_typosquat_registry(spark, sf):
    """Look-alikes of any registered domain, not of a fixed list."""
    found = _url_features(spark, sf).select(*_OWNER, "full_domain")
    return flag_lookalikes(found, _registered_domains(spark, sf))


@query
def url_agg(spark, sf):
    return FE.with_url_summary(_mails(spark, sf, "body_text"), "body_text").select("mail_id", *FE.URL_FEATURES)


@query
def url_agg_rows(spark, sf):
    """The same summary for links stored one per row."""
    return aggregate_url_rows(U.with_url_features(url_find(spark, sf)), "mail_id")


# --- Headers ----------------------------------------------------------------


@query
def hdr_explode(spark, sf):
    return MT.header_rows(_mails(spark, sf, "raw_email_source"))


@query
def hdr_address(spark, sf):
    kinds = ("from", "reply_to", "return_path", "sender")
    df = _mails(spark, sf, "raw_email_source").withColumn("head", H.header_block(F.col("raw_email_source")))
    df = U.with_stages(df, [H.read_stage, *H.together(*[H.address_stages(k) for k in kinds])])
    return df.select("mail_id", F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(f"{k}_addr").alias("addr"), F.col(f"{k}_name").alias("name"),
                 F.col(f"{k}_domain").alias("domain")) for k in kinds])))


def _header_features(spark, sf, with_urls: bool = False) -> DataFrame:
    df = _mails(spark, sf, "body_text", "raw_email_source")
    if with_urls:
        df = FE.with_url_summary(df, "body_text")
        return FE.with_header_features(df, "raw_email_source", "url_domains")
    return FE.with_header_features(df, "raw_email_source")


@query
def hdr_auth(spark, sf):
    df = _mails(spark, sf, "raw_email_source").withColumn("head", H.header_block(F.col("raw_email_source")))
    df = U.with_stages(df, [H.read_stage, *H.auth_stages()])
    return df.select("mail_id", "spf_result", "dkim_result", "dmarc_result", "auth_all_failed")


@query
def hdr_mismatch(spark, sf):
    return _header_features(spark, sf).select(
        "mail_id", "from_returnpath_mismatch", "from_replyto_mismatch", "sender_header_mismatch",
        "reply_to_is_free_email", "sender_uses_free_email")


@query
def hdr_url_mismatch(spark, sf):
    return _header_features(spark, sf, with_urls=True).select("mail_id", "from_domain", "sender_url_domain_mismatch")


@query
def hdr_impersonation(spark, sf):
    return _header_features(spark, sf).select("mail_id", "from_name", "display_name_impersonation")


@query
def hdr_received(spark, sf):
    return _header_features(spark, sf).select("mail_id", "received_chain_length", "received_chain_missing")


@query
def hdr_message_id(spark, sf):
    return _header_features(spark, sf).select("mail_id", "message_id_domain_mismatch")


@query
def hdr_mailer(spark, sf):
    return _header_features(spark, sf).select("mail_id", "suspicious_mailer", "has_script_originating_header")


@query
def att_flags(spark, sf):
    return FE.with_attachment_features(_mails(spark, sf, "raw_email_source"), "raw_email_source").select(
        "mail_id", *H.ATTACHMENT_FEATURES)


# --- Text -------------------------------------------------------------------


@query
def txt_sentences(spark, sf):
    return _mails(spark, sf, "body_text").select(
        "mail_id", F.posexplode(X.sentences(F.col("body_text"))).alias("no", "sentence"))


def _text_features(spark, sf, *names: str) -> DataFrame:
    return FE.with_text_features(_mails(spark, sf, "body_text"), "body_text", names).select("mail_id", *names)


@query
def txt_structure(spark, sf):
    return _text_features(spark, sf, "sentence_count", "word_count")


@query
def txt_burstiness(spark, sf):
    return _text_features(spark, sf, "burstiness_score", "low_burstiness_flag")


@query
def txt_lexicon(spark, sf):
    return _text_features(spark, sf, *X.TERM_COUNTS)


@query
def txt_patterns(spark, sf):
    return _text_features(spark, sf, "prompt_leakage_detected", "out_of_band_excuse_count")


@query
def txt_combos(spark, sf):
    return _text_features(spark, sf, "urgency_financial_combo", "personalization_financial_mismatch")


@query
def txt_evidence(spark, sf):
    lowered = _mails(spark, sf, "body_text").select("mail_id", F.lower("body_text").alias("lowered"))
    found = lowered.select("mail_id", F.explode(X.evidence(F.col("lowered"))).alias("category", "terms"))
    return found.select("mail_id", "category", F.array_join("terms", "|").alias("matches"))


# --- Wide table, data sets --------------------------------------------------


def _wide(spark, sf) -> DataFrame:
    return FE.mail_features(dealt_mails(spark, sf))


@query
def mail_features_wide(spark, sf):
    return _wide(spark, sf)


@query
def onehot_auth(spark, sf):
    hot = FE.one_hot_auth(_wide(spark, sf))
    return hot.select("mail_id", *[
        f"header__{c}_{v}" for c in FE.CATEGORICAL for v in lx.AUTH_VOCABULARY])


@query
def src_mail_csv(spark, sf):
    """Round trip through quoted multi-line CSV in the checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark)}/{_unique('mail-csv')}"
    MT.write_mail_csv(fixture(spark, sf, "mail").withColumnRenamed("mail_id", "id"), path)
    return MT.read_mail_csv(spark, path)


def _unique(stem: str) -> str:
    return f"{stem}-{uuid.uuid4().hex}"


@query
def src_partial_headers(spark, sf):
    return MT.from_partial_headers(fixture(spark, sf, "partial"))


@query
def src_capped_sample(spark, sf):
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), "text", F.col("quality").alias("label"))
    return MT.from_text_labels(labelled, max_rows=250).select("id", "label", "body_text")


@query
def gen_mail(spark, sf):
    return G.expand_templates(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


def _domain_of(key: str) -> Column:
    return F.element_at(F.array(*[F.lit(d) for _, d in G.ENTITIES]),
                        (F.pmod(F.col(key), F.lit(len(G.ENTITIES))) + 1).cast("int"))


@query
def gen_spoof_domain(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", _domain_of("c_custkey").alias("real"))
    return df.withColumn("spoofed", G.spoof_domain(F.col("real"), F.col("c_custkey")))


@query
def gen_fake_url(spark, sf):
    styles = ["typosquat", "ip_address", "shortener", "email_embedded", "at_symbol", "clean"]
    key = F.col("c_custkey")
    df = table(spark, sf, "customer").withColumns({
        "real": _domain_of("c_custkey"),
        "style": F.element_at(F.array(*[F.lit(s) for s in styles]), (F.pmod(key, F.lit(6)) + 1).cast("int")),
        "victim": F.concat(F.lower("c_mktsegment"), F.lit("@example.com")),
    })
    df = df.withColumn("spoofed", G.spoof_domain(F.col("real"), key))
    return df.select("c_custkey", "style", G.fake_url(
        F.col("style"), F.col("real"), F.col("spoofed"), F.col("victim"), key).alias("url"))


@query
def manifest_check(spark, sf):
    return check_uploads(fixture(spark, sf, "upload")).select("upload_id", "extension", "reason", "accepted")


@query
def flt_short_body(spark, sf):
    return D.drop_short_bodies(fixture(spark, sf, "partial"), "body").select("row_id", "body")


@query
def mail_union(spark, sf):
    mail = _mails(spark, sf, "label", "subject").select(
        F.lit("mail").alias("origin"), F.col("mail_id").alias("id"), "label", "subject")
    partial = fixture(spark, sf, "partial").select(
        F.lit("partial").alias("origin"), F.col("row_id").alias("id"), "label",
        F.coalesce("subject", F.lit("(no subject)")).alias("subject"))
    return D.union_mails(mail, partial)


@query
def label_counts(spark, sf):
    return D.count_by(fixture(spark, sf, "mail"), "label", "template_id", "category")


@query
def class_balance(spark, sf):
    return D.balance_classes(table(spark, sf, "documents"), "lang", "doc_id").select("doc_id", "lang")


@query
def shuffle_renumber(spark, sf):
    return renumber(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")


@query
def stratified_split(spark, sf):
    return D.stratified_split(table(spark, sf, "documents"), 0.2, "lang", "doc_id").select("doc_id", "lang", "is_test")


@query
def stratified_folds(spark, sf):
    return D.stratified_folds(table(spark, sf, "documents"), 5, "lang", "doc_id").select("doc_id", "lang", "fold")


# --- Learning ---------------------------------------------------------------


def _train_columns(spark, sf) -> tuple[DataFrame, list[str]]:
    hot = FE.one_hot_auth(_wide(spark, sf), FE.header_vocabulary(_mails(spark, sf, "raw_email_source")))
    return hot, FE.feature_columns(hot)


def _training_rows(spark, sf) -> tuple[DataFrame, list[str]]:
    hot, columns = _train_columns(spark, sf)
    table_ = L.training_table(hot, columns)
    return D.stratified_split(table_), columns


_FITTED: dict[tuple[str, str], tuple] = {}


def _fitted(spark, sf):
    """Training rows and model of a session, fitted once and used by every
    query that scores or explains."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITTED:
        rows, columns = _training_rows(spark, sf)
        _FITTED[key] = (L.fit_mail_model(rows.filter(~F.col("is_test")), columns), columns)
    return _FITTED[key]


@query
def model_cv(spark, sf):
    rows, _ = _training_rows(spark, sf)
    train = rows.filter(~F.col("is_test")).drop("is_test")
    return L.cv_summary(L.cross_validate(train)).withColumns({
        "mean_accuracy": F.round("mean_accuracy", 4), "std_accuracy": F.round("std_accuracy", 4)})


@query
def model_scores(spark, sf):
    """Fit on the training share, score every mail in bulk."""
    model, _ = _fitted(spark, sf)
    hot = FE.one_hot_auth(_wide(spark, sf), model_vocabulary(model))
    return L.score_mails(model, hot, ("mail_id", "label")).select(
        "mail_id", "label", "phishing_probability", "risk_tier", "prediction")


@query
def tree_scores(spark, sf):
    """Scores from a saved node table: trees by rule, written, loaded and compiled."""
    path = f"{ensure_checkpoint_dir(spark)}/nodes-{uuid.uuid4().hex}"
    hot = FE.one_hot_auth(_wide(spark, sf))
    save_nodes(node_table(spark, [Node(*n) for n in rule_nodes(FE.feature_columns(hot))]), path)
    return L.score_mails(load_nodes(spark, path), hot, ("mail_id", "label")).select(
        "mail_id", "label", "phishing_probability", "risk_tier", "prediction")


@query
def model_scores_agree(spark, sf):
    """The fitted trees as one expression against the library's own transform: the same
    probability for every mail."""
    model, columns = _fitted(spark, sf)
    hot = FE.one_hot_auth(_wide(spark, sf), model_vocabulary(model))
    ours = L.with_probability(FE.align(hot, columns, ("mail_id", "label")), L.model_nodes(model), "_p")
    both = model.transform(ours).withColumn("_q", vector_to_array("probability")[1])
    return both.select("mail_id", "label", (F.abs(F.col("_p") - F.col("_q")) < 1e-9).alias("same"))


ALIGNED_EXTRA = ["header__arc_result_pass", "text__emoji_count"]


@query
def feature_align(spark, sf):
    """The column list of a model: every second feature, and two the table lacks."""
    hot = FE.one_hot_auth(_wide(spark, sf))
    return FE.align(hot, [*sorted(FE.feature_columns(hot))[::2], *ALIGNED_EXTRA], ("mail_id",))


@query
def model_importances(spark, sf):
    return L.top_importances(_fitted(spark, sf)[0], spark)


@query
def mail_scan(spark, sf):
    """The whole mail answer: probability, tier, decision, signals, sender."""
    return scan_mails(dealt_mails(spark, sf), _fitted(spark, sf)[0])


@query
def mail_scan_facts(spark, sf):
    """What the mail answer says apart from the fitted trees: sender check and all
    text matches, and that probability, tier and decision are of their domains."""
    scanned = scan_mails(dealt_mails(spark, sf), _fitted(spark, sf)[0])
    sound = (F.col("phishing_probability").between(0, 1) & F.col("risk_tier").isin("SAFE", "SUSPICIOUS", "PHISHING")
             & F.col("prediction").isin("phishing", "legitimate") & (F.size("top_risk_signals") <= lx.TOP_RISK_SIGNALS))
    return scanned.select(
        "mail_id", "sender_verified", "sender_entity", "domain_checked", sound.alias("sound"),
        F.explode("text_matches").alias("category", "terms")).withColumn("matches", F.array_join("terms", "|")).drop("terms")


@query
def model_facts(spark, sf):
    """Importances of the fitted model: one per feature, none negative, one in sum."""
    found = L.importances(_fitted(spark, sf)[0])
    return spark.createDataFrame(list(found.items()), "feature string, importance double").agg(
        F.count("*").alias("n_features"), F.min(F.col("importance") >= 0).alias("none_negative"),
        F.round(F.sum("importance"), 6).alias("total"))


@query
def eval_metrics(spark, sf):
    return L.evaluate(fixture(spark, sf, "prediction"))


@query
def eval_confusion(spark, sf):
    return L.confusion_matrix(fixture(spark, sf, "prediction"))


@query
def eval_report(spark, sf):
    return L.class_report(fixture(spark, sf, "prediction"))


@query
def tiering(spark, sf):
    p = F.col("probability")
    return fixture(spark, sf, "prediction").select(
        "mail_id", *[risk_tier(p, top).alias(f"{channel}_tier") for channel, top in lx.TOP_TIER.items()],
        decision(p, "phishing", "legitimate").alias("decision"))


@query
def top_signals(spark, sf):
    hot, columns = _train_columns(spark, sf)
    weights = {n: float(i + 1) for i, n in enumerate(sorted(columns))}
    lists = L.with_top_signals(hot, weights).select("mail_id", "top_risk_signals", "top_trust_signals")

    def entries(kind: str) -> Column:
        return F.transform(f"top_{kind}_signals", lambda s, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("rank"), s["feature"].alias("feature"), s["value"].alias("value")))

    # The outer form keeps the optimizer from copying the whole feature
    # computation into a filter below the explode.
    both = lists.select("mail_id", F.concat(entries("risk"), entries("trust")).alias("s"))
    return both.select("mail_id", F.inline_outer("s")).filter(F.col("feature").isNotNull())


# --- Posts ------------------------------------------------------------------

AS_OF = "2024-02-01"


def _behaviour(spark, sf) -> DataFrame:
    return with_behaviour(fixture(spark, sf, "post"), F.lit(AS_OF).cast("date"))


@query
def beh_age(spark, sf):
    return _behaviour(spark, sf).select("post_id", "account_age_days", "very_new_account")


@query
def beh_flags(spark, sf):
    return _behaviour(spark, sf).select(
        "post_id", "abnormal_posting_frequency", "follower_following_ratio", "suspicious_follow_ratio",
        "suspicious_handle_pattern", "suspicious_bio_keyword_count")


@query
def beh_redflags(spark, sf):
    return _behaviour(spark, sf).select("post_id", "behavioral_red_flag_count", "likely_coordinated_or_bot")


@query
def soc_text_risk(spark, sf):
    df = FE.with_text_features(fixture(spark, sf, "post").select("post_id", "post_text"), "post_text", S.TEXT_RISK_FEATURES)
    return df.select("post_id", round_exact(S.text_risk(F.col), 4).alias("text_risk_score"))


@query
def soc_fusion(spark, sf):
    return scan_posts(fixture(spark, sf, "post"), F.lit(AS_OF).cast("date"), features=False)


@query
def stream_post_scan(spark, sf):
    """Posts that land in several files, scanned as a stream that stops when all are
    done and is started once more; the sink read back."""
    place = f"{ensure_checkpoint_dir(spark)}/{_unique('posts')}"
    posts = fixture(spark, sf, "post")
    posts.repartition(3).write.parquet(f"{place}/landing")
    for _ in range(2):
        landed = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 2).parquet(f"{place}/landing")
        scanned = scan_posts(landed, F.lit(AS_OF).cast("date"), features=False)
        ST.write_stream(scanned, f"{place}/scanned", f"{place}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{place}/scanned")


# --- Registry ---------------------------------------------------------------


def _reg(spark, sf, kind: str) -> DataFrame:
    return fixture(spark, sf, kind)


_OWNER_COLS = ("entity_id", "entity_name", "status", "verified")


@query
def ver_domain(spark, sf):
    return R.verify_domains(fixture(spark, sf, "claim"), _reg(spark, sf, "entity_domain"), _reg(spark, sf, "entity")).select(
        "claim_id", "domain_checked", *_OWNER_COLS)


@query
def ver_handle(spark, sf):
    return R.verify_handles(fixture(spark, sf, "claim"), _reg(spark, sf, "entity_handle"), _reg(spark, sf, "entity")).select(
        "claim_id", "platform_checked", "handle_checked", *_OWNER_COLS)


@query
def ver_phone(spark, sf):
    return R.verify_phones(fixture(spark, sf, "claim"), _reg(spark, sf, "entity_phone"), _reg(spark, sf, "entity")).select(
        "claim_id", "phone_number_checked", *_OWNER_COLS)


@query
def ver_executive(spark, sf):
    return R.verify_executives(
        fixture(spark, sf, "claim"), _reg(spark, sf, "entity_executive"), _reg(spark, sf, "entity")).select(
        "claim_id", "executive_authorized", "executive_entity", "executive_status")


def _senders(spark, sf) -> DataFrame:
    return FE.with_header_features(_mails(spark, sf, "raw_email_source"), "raw_email_source").select("mail_id", "from_addr")


@query
def ver_sender(spark, sf):
    return R.verify_senders(_senders(spark, sf))


def _communications(spark, sf) -> DataFrame:
    return fixture(spark, sf, "communication").withColumn("content_hash", content_hash(F.col("content"))).drop("content")


@query
def ver_token(spark, sf):
    out = R.lookup_tokens(fixture(spark, sf, "token_claim"), _communications(spark, sf), _reg(spark, sf, "entity"))
    return out.drop("content")


@query
def ver_token_content(spark, sf):
    out = R.verify_token_contents(
        fixture(spark, sf, "token_claim"), _communications(spark, sf), _reg(spark, sf, "entity"))
    return out.select("claim_id", "entity_name", "reason", "verified")


@query
def ver_signature(spark, sf):
    """Contents that carry entity and signature themselves; some name no known entity."""
    lost = (F.col("channel") == "sms") & (F.length("content") % 9 == 0)
    claims = fixture(spark, sf, "communication").withColumn(
        "entity_id", F.when(lost, F.col("entity_id") + 1_000_000).otherwise(F.col("entity_id")))
    out = R.verify_signed_contents(claims.withColumnRenamed("verification_token", "token"), _reg(spark, sf, "entity"))
    return out.select("token", "entity_name", "reason", "verified")


@query
def content_hash_(spark, sf):
    return table(spark, sf, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))


QUERIES["content_hash"] = QUERIES.pop("content_hash_")


@query
def reg_enroll(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("claim_id"), (F.col("o_custkey") + 5000).alias("entity_id"))
    additions = fixture(spark, sf, "claim").select("claim_id", "domain").join(orders, "claim_id")
    return R.add_domains(_reg(spark, sf, "entity_domain"), additions, "claim_id").select("domain", "entity_id")


def _claims_by_customer(spark, sf, *columns):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("claim_id"), (F.col("o_custkey") + 5000).alias("entity_id"))
    return fixture(spark, sf, "claim").select("claim_id", *columns).join(orders, "claim_id")


@query
def reg_enroll_phones(spark, sf):
    added = _claims_by_customer(spark, sf, "phone_number")
    return R.add_phones(_reg(spark, sf, "entity_phone"), added, "claim_id").select("phone_number", "entity_id")


@query
def reg_enroll_handles(spark, sf):
    added = _claims_by_customer(spark, sf, "platform", "handle")
    return R.add_handles(_reg(spark, sf, "entity_handle"), added, "claim_id").select("platform", "handle", "entity_id")


@query
def reg_enroll_executives(spark, sf):
    added = _claims_by_customer(spark, sf, "claimed_speaker_name").withColumnRenamed("claimed_speaker_name", "executive_name")
    return R.add_executives(_reg(spark, sf, "entity_executive"), added, "claim_id").select("executive_name", "entity_id")


@query
def reg_enroll_entities(spark, sf):
    requests = table(spark, sf, "customer").select(
        (F.col("c_custkey") + 1).alias("request_no"), F.col("c_name").alias("entity_name"),
        F.lit("other").alias("entity_type"), F.lit(None).cast("string").alias("registration_number"),
        F.lit("PEM").alias("public_key_pem"), F.lit(1).alias("authorized_by_id"))
    return R.enroll_entities(_reg(spark, sf, "entity"), requests).select("id", "entity_name", "entity_type", "status")


@query
def reg_revoke(spark, sf):
    """Suppliers with more than a quarter of their lines returned."""
    shares = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("back"), F.count("*").alias("n"))
    revocations = shares.filter("back * 4 > n").select((F.col("l_suppkey") + 1).alias("entity_id"))
    out = R.revoke_entities(_reg(spark, sf, "entity"), revocations, F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return out.select("id", "entity_name", "status", "changed")


@query
def reg_seed(spark, sf):
    key = F.col("c_custkey")
    known = table(spark, sf, "customer").select(
        (key + 1).alias("request_no"), F.col("c_name").alias("entity_name"),
        F.array(F.concat(F.lit("s"), (key * 3).cast("string"), F.lit(".example.com")),
                F.concat(F.lit("c"), key.cast("string"), F.lit(".example.org"))).alias("domains"))
    out = R.seed_requests(known, _reg(spark, sf, "entity_domain"), _reg(spark, sf, "entity"), "Supplier#000000000")
    return out.select("entity_name", "id", "authorized_by_id")


# --- Media ------------------------------------------------------------------


@query
def med_frame_sample(spark, sf):
    return M.sample_frames(fixture(spark, sf, "frame"))


@query
def med_crop_box(spark, sf):
    return M.crop_boxes(fixture(spark, sf, "face_box")).select(
        "media_id", "line_no", "frame_index", "x", "y", "w", "h", "crop_x1", "crop_y1", "crop_x2", "crop_y2")


@query
def med_segments(spark, sf):
    return M.audio_segments(fixture(spark, sf, "clip")).drop("total_samples")


@query
def med_unit_score(spark, sf):
    entries = F.array(F.struct(F.col("first_label").alias("label"), F.col("p_first").alias("p")),
                      F.struct(F.col("second_label").alias("label"), F.col("p_second").alias("p")))
    return fixture(spark, sf, "unit_probability").select(
        "unit_id", M.unit_label(entries).alias("label"), M.unit_fake_probability(entries).alias("fake_probability"))


def _verdicts(spark, sf, channel: str) -> DataFrame:
    media = fixture(spark, sf, "media").select("media_id")
    return M.media_verdicts(media, fixture(spark, sf, "media_unit"), channel)


@query
def med_verdict(spark, sf):
    return reduce(DataFrame.unionByName, [
        _verdicts(spark, sf, c).withColumn("channel", F.lit(c)) for c in ("video", "audio")])


@query
def med_exec(spark, sf):
    claims = fixture(spark, sf, "claim").select(F.col("claim_id").alias("media_id"), "claimed_speaker_name")
    out = RP.media_with_claims(_verdicts(spark, sf, "video"), claims,
                               _reg(spark, sf, "entity_executive"), _reg(spark, sf, "entity"))
    return out.select("media_id", "risk_tier", "claimed_speaker_name", "executive_authorized", "executive_status",
                      "executive_impersonation")


# --- Reports ----------------------------------------------------------------


@query
def mail_verdict(spark, sf):
    p = F.col("probability")
    scored = fixture(spark, sf, "prediction").select(
        "mail_id", round_exact(p, 4).alias("phishing_probability"), risk_tier(p, "PHISHING").alias("risk_tier"),
        decision(p, "phishing", "legitimate").alias("prediction"))
    return RP.mail_verdicts(scored, _senders(spark, sf)).drop("from_addr")


@query
def incident_report(spark, sf):
    p = F.col("probability")
    mail = fixture(spark, sf, "prediction").select(
        F.col("mail_id").alias("incident_id"), risk_tier(p, "PHISHING").alias("risk_tier"), p.alias("score"))
    video = _verdicts(spark, sf, "video").select(
        F.col("media_id").alias("incident_id"), "risk_tier", F.col("fake_probability").alias("score"))
    order = F.array(*[F.lit(t) for t in ("SAFE", "SUSPICIOUS", "MANIPULATIVE")])
    worst = (scan_posts(fixture(spark, sf, "post"), F.lit(AS_OF).cast("date"), ("user_id",), features=False)
             .groupBy(F.col("user_id").alias("incident_id")).agg(
                 F.max("fused_risk_score").alias("score"),
                 F.max(F.array_position(order, F.col("risk_tier"))).alias("_worst")))
    # Tiers rise with the score before rounding, so the worst tier is that of the highest.
    social = worst.select("incident_id", F.element_at(order, F.col("_worst").cast("int")).alias("risk_tier"), "score")
    return RP.incident_report({"mail": mail, "video": video, "social": social})


@query
def verdict_text(spark, sf):
    from .oracle import MODEL_NAMES

    p = F.col("probability")
    names = F.array(*[F.lit(n) for n in sorted(MODEL_NAMES)])
    df = fixture(spark, sf, "prediction").withColumn(
        "feature", F.element_at(names, (F.pmod("mail_id", F.lit(len(MODEL_NAMES))) + 1).cast("int")))
    return df.select("mail_id", *[
        RP.verdict_text(F.lit(c), risk_tier(p, lx.TOP_TIER[c])).alias(f"{c}_text")
        for c in ("mail", "video", "audio", "social")
    ], RP.signal_text(F.col("feature")).alias("signal_text"))
