"""Entity registry: bulk checks of claims and registry maintenance.

Claims are the big side. No join is hinted: Spark broadcasts a registry side from its
bytes, at run time too; otherwise the join shuffles and AQE splits keys that many
claims share. Registry keys are unique, so a claim never multiplies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions.headers import address_domain_stages
from ..functions.signatures import content_hash, signature_valid
from ..functions.strings import flag, strip
from ..functions.urls import with_stages


def normal_domain(c: Column) -> Column:
    return strip(F.lower(c))


def normal_handle(c: Column) -> Column:
    """Leading ``@`` go before white space does, so ``' @x'`` keeps its sign."""
    return strip(F.ltrim(F.lower(c), F.lit("@")))


def _identity(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("id").alias("entity_id"), "entity_name", "status")


def _check(claims: DataFrame, keys: dict[str, Column], registered: DataFrame, entities: DataFrame) -> DataFrame:
    """Left-join normalised claim keys to the registry; a miss is unverified."""
    owners = registered.select(*keys, "entity_id").join(_identity(entities), "entity_id")
    checked = claims.withColumns({f"{k}_checked": c for k, c in keys.items()})
    on = [F.col(f"{k}_checked") == F.col(f"_{k}") for k in keys]
    side = owners.withColumnsRenamed({k: f"_{k}" for k in keys})
    out = checked.join(side, on, "left").drop(*[f"_{k}" for k in keys])
    return out.withColumn("verified", flag(F.col("status") == "active"))


def verify_domains(claims: DataFrame, domains: DataFrame, entities: DataFrame, col: str = "domain") -> DataFrame:
    return _check(claims, {"domain": normal_domain(F.col(col))}, domains, entities)


def verify_handles(claims: DataFrame, handles: DataFrame, entities: DataFrame,
                   platform_col: str = "platform", handle_col: str = "handle") -> DataFrame:
    return _check(claims, {"platform": normal_domain(F.col(platform_col)),
                           "handle": normal_handle(F.col(handle_col))}, handles, entities)


def verify_phones(claims: DataFrame, phones: DataFrame, entities: DataFrame, col: str = "phone_number") -> DataFrame:
    return _check(claims, {"phone_number": strip(F.col(col))}, phones, entities)


def verify_executives(claims: DataFrame, executives: DataFrame, entities: DataFrame,
                      col: str = "claimed_speaker_name") -> DataFrame:
    """Exact, case-sensitive name; the entity's status plays no part. No name
    claimed gives NULL, a name of several entities the lowest entity id."""
    owners = (executives.join(_identity(entities), "entity_id")
              .groupBy(F.col("executive_name").alias("_name"))
              .agg(F.min_by("entity_name", "entity_id").alias("executive_entity")))
    name = strip(F.col(col))
    out = claims.join(owners, name == F.col("_name"), "left")
    claimed = F.coalesce(F.col(col), F.lit("")) != ""
    return out.withColumns({
        "executive_authorized": F.when(claimed, F.col("_name").isNotNull()),
        "executive_status": F.when(claimed, F.when(
            F.col("_name").isNotNull(),
            F.concat(F.lit("PASSED (Authorized under "), F.col("executive_entity"), F.lit(")")))
            .otherwise(F.lit("FAILED (Not an authorized executive)"))),
    }).drop("_name")


def known_sender(domain: Column) -> Column:
    """Entity name of a registrable domain among the known ones: a hash-set
    lookup in a map literal, no join."""
    known = F.create_map(*[F.lit(x) for pair in lx.KNOWN_ENTITY_DOMAINS.items() for x in pair])
    return F.when(domain.isin(*lx.KNOWN_ENTITY_DOMAINS), F.element_at(known, domain))


def verify_senders(df: DataFrame, addr_col: str = "from_addr") -> DataFrame:
    """Add ``domain_checked``, ``sender_entity`` and ``sender_verified``."""
    found = with_stages(df.withColumn("_s_addr", F.col(addr_col)), address_domain_stages("_s"))
    return (found.select(*df.columns, F.col("_s_domain").alias("domain_checked"))
            .withColumn("sender_entity", known_sender(F.col("domain_checked")))
            .withColumn("sender_verified", F.col("sender_entity").isNotNull()))


# --- Signed communications --------------------------------------------------


def token_table(communications: DataFrame, entities: DataFrame) -> DataFrame:
    owners = entities.select(F.col("id").alias("entity_id"), "entity_name", "entity_type", "status", "public_key_pem")
    return communications.join(owners, "entity_id")


def verification_link(token: Column, base_url: str) -> Column:
    return F.concat(F.lit(base_url.rstrip("/") + "/v/"), token)


def lookup_tokens(tokens: DataFrame, communications: DataFrame, entities: DataFrame,
                  token_col: str = "token", base_url: str = "https://verify.example") -> DataFrame:
    """Identity, recorded hash and present validity of the tokens that exist."""
    side = token_table(communications, entities).select(
        F.col("verification_token").alias("_token"), "entity_name", "entity_type",
        F.col("status").alias("entity_status"), "content_hash", "channel", "subject",
        (F.col("status") == "active").alias("currently_valid"))
    out = tokens.join(side, F.col(token_col) == F.col("_token")).drop("_token")
    return out.withColumn("link", verification_link(F.col(token_col), base_url))


def verify_token_contents(claims: DataFrame, communications: DataFrame, entities: DataFrame,
                          token_col: str = "token", content_col: str = "content") -> DataFrame:
    """First failing test of each claim: unknown token, revoked entity, altered
    content, wrong signature. Only claims past the first three reach the
    signature check."""
    side = token_table(communications, entities).select(
        F.col("verification_token").alias("_token"), "entity_name", "status",
        F.col("content_hash").alias("_hash"), "signature_b64", "public_key_pem")
    joined = claims.withColumn("_digest", content_hash(F.col(content_col))).join(
        side, F.col(token_col) == F.col("_token"), "left")
    early = (F.when(F.col("_token").isNull(), F.lit("unknown_token"))
             .when(F.col("status") != "active", F.lit("entity_revoked"))
             .when(F.col("_digest") != F.col("_hash"), F.lit("content_tampered")))
    return _with_signature_check(joined.withColumn("_early", early)).drop("_token", "_hash", "status")


def verify_signed_contents(claims: DataFrame, entities: DataFrame, entity_col: str = "entity_id",
                           content_col: str = "content") -> DataFrame:
    """Claims that carry entity, content and signature themselves."""
    side = entities.select(F.col("id").alias("_id"), "entity_name", "status", "public_key_pem")
    joined = claims.withColumn("_digest", content_hash(F.col(content_col))).join(
        side, F.col(entity_col) == F.col("_id"), "left")
    early = (F.when(F.col("_id").isNull(), F.lit("unknown_entity"))
             .when(F.col("status") != "active", F.lit("entity_revoked")))
    return _with_signature_check(joined.withColumn("_early", early)).drop("_id", "status")


def _with_signature_check(df: DataFrame) -> DataFrame:
    alive = F.col("_early").isNull()
    valid = signature_valid(F.when(alive, F.col("public_key_pem")), F.col("_digest"), F.col("signature_b64"))
    out = df.withColumn("verified", valid)
    return out.withColumn("reason", F.coalesce(
        F.col("_early"), F.when(~F.col("verified"), F.lit("signature_mismatch")))
    ).drop("_early", "_digest", "public_key_pem", "signature_b64")


# --- Maintenance: every step returns a new snapshot -------------------------


def enroll_entities(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """Append entities; ``request_no`` (1, 2, ...) in arrival order follows the
    highest id so far."""
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    new = requests.select(
        (F.col("request_no") + F.lit(top)).cast("bigint").alias("id"), "entity_name", "entity_type",
        "registration_number", "public_key_pem", F.lit("active").alias("status"), "authorized_by_id")
    return existing.select(*new.columns).unionByName(new)


def add_keys(existing: DataFrame, additions: DataFrame, keys: dict[str, Column], arrival_col: str,
             owner_in_key: bool = False) -> DataFrame:
    """Add normalised keys; the first owner of a key keeps it, an addition without a
    key is no key. ``arrival_col``
    is a unique number, zero or more. ``min_by`` combines on the map side, so a
    key added very often stays cheap."""
    old = existing.select("entity_id", *keys, F.lit(-1).cast("bigint").alias("_at"))
    new = additions.select("entity_id", *[c.alias(k) for k, c in keys.items()],
                           F.col(arrival_col).cast("bigint").alias("_at")).dropna(subset=list(keys))
    both = old.unionByName(new)
    if owner_in_key:
        return both.select("entity_id", *keys).distinct()
    return both.groupBy(*keys).agg(
        F.min_by("entity_id", "_at").alias("entity_id")
    ).select("entity_id", *keys)


def add_domains(existing: DataFrame, additions: DataFrame, arrival_col: str = "arrival") -> DataFrame:
    return add_keys(existing, additions, {"domain": normal_domain(F.col("domain"))}, arrival_col)


def add_phones(existing: DataFrame, additions: DataFrame, arrival_col: str = "arrival") -> DataFrame:
    return add_keys(existing, additions, {"phone_number": strip(F.col("phone_number"))}, arrival_col)


def add_handles(existing: DataFrame, additions: DataFrame, arrival_col: str = "arrival") -> DataFrame:
    return add_keys(existing, additions, {
        "platform": normal_domain(F.col("platform")), "handle": normal_handle(F.col("handle"))}, arrival_col)


def add_executives(existing: DataFrame, additions: DataFrame, arrival_col: str = "arrival") -> DataFrame:
    return add_keys(existing, additions, {"executive_name": strip(F.col("executive_name"))}, arrival_col,
                    owner_in_key=True)


def revoke_entities(entities: DataFrame, revocations: DataFrame, at: Column) -> DataFrame:
    """Revoke the listed active entities at time ``at``; ``changed`` marks them."""
    listed = revocations.select(F.col("entity_id").alias("_id")).distinct()
    out = entities.join(listed, F.col("id") == F.col("_id"), "left")
    changed = F.col("_id").isNotNull() & (F.col("status") == "active")
    before = F.col("revoked_at") if "revoked_at" in entities.columns else F.lit(None).cast("timestamp")
    return out.withColumns({
        "changed": changed,
        "revoked_at": F.when(changed, at).otherwise(before),
        "status": F.when(changed, F.lit("revoked")).otherwise(F.col("status")),
    }).drop("_id")


def seed_requests(known: DataFrame, domains: DataFrame, entities: DataFrame, regulator_name: str) -> DataFrame:
    """Known entities still to enrol: those without any registered domain, with
    their future ``id``. ``known`` has one row per entity, ``request_no`` and an
    array ``domains``; all but the regulator are authorised by the regulator,
    whether it is enrolled already or comes with this batch."""
    wanted = known.select("entity_name", F.explode("domains").alias("_domain"))
    present = wanted.join(domains.select(F.col("domain").alias("_domain")), "_domain", "left_semi")
    missing = known.join(present.select("entity_name").distinct(), "entity_name", "left_anti")
    top = entities.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    is_regulator = F.col("entity_name") == regulator_name
    enrolled = entities.filter(is_regulator).agg(F.min("id").alias("m")).first()["m"]
    coming = missing.filter(is_regulator).agg(F.min("request_no").alias("m")).first()["m"]
    root = enrolled if coming is None else top + coming
    return missing.withColumns({
        "id": (F.col("request_no") + F.lit(top)).cast("bigint"),
        "authorized_by_id": F.when(~is_regulator, F.lit(root).cast("bigint")),
    })


def registry_violations(registered: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once where they must be unique."""
    return registered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
