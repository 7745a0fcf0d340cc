"""Mail header features as column expressions over the raw message.

Reading one header is one multi-line regular expression over the unfolded
header block, so a message stays one row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx
from .domains import Getter, host_of, registrable
from .strings import WORD, contains_any, count_terms, one_of, strip

HEADER_FEATURES = [
    "spf_result", "dkim_result", "dmarc_result", "auth_all_failed",
    "from_returnpath_mismatch", "from_replyto_mismatch", "reply_to_is_free_email",
    "sender_header_mismatch", "sender_uses_free_email", "display_name_impersonation",
    "sender_url_domain_mismatch", "received_chain_length", "received_chain_missing",
    "message_id_domain_mismatch", "suspicious_mailer", "has_script_originating_header",
]
ATTACHMENT_FEATURES = [
    "num_attachments", "has_dangerous_attachment", "has_macro_attachment",
    "has_double_extension_attachment", "attachment_social_keyword_count",
]

# A header line: a name and a colon, a continuation, or an envelope line.
_HEADER_LINE = r"(?:From |[!-9;-~]*:|[\t ])"


def normal_newlines(raw: Column) -> Column:
    return F.when(raw.contains("\r"), F.regexp_replace(raw, r"\r\n?", "\n")).otherwise(raw)


def header_block(raw: Column) -> Column:
    """Lines up to the first that is no header line; folded lines joined."""
    block = F.regexp_extract(
        normal_newlines(raw), rf"(?s)\A(?={_HEADER_LINE})(.*?)(?:\n(?!{_HEADER_LINE})|\z)", 1)
    return F.regexp_replace(block, r"\n[ \t]+", " ")


def body_of(raw: Column) -> Column:
    """Text after the header block; a missing blank line is tolerated."""
    text = normal_newlines(raw)
    rest = F.regexp_replace(
        text, rf"(?s)\A(?={_HEADER_LINE}).*?(?:\n(?!{_HEADER_LINE})|\z)", "")
    return F.regexp_replace(rest, r"\A\n", "")


def header(block: Column, name: str) -> Column:
    """First value of a header, '' when absent; names ignore case."""
    return F.trim(F.regexp_extract(block, rf"(?imd)^{re.escape(name)}:[ \t]*(.*)$", 1))


# --- Addresses --------------------------------------------------------------


def address_stages(prefix: str) -> list:
    """Stages from ``<prefix>_raw`` to ``<prefix>_name``, ``<prefix>_addr`` and
    ``<prefix>_domain``. Several addresses in one header give none."""

    def bare(get: Getter) -> dict[str, Column]:
        # Quoted names and comments may hold any character: take them out first.
        v = get(f"{prefix}_raw")
        return {f"{prefix}_bare": F.trim(F.regexp_replace(v, r'"[^"]*"|\([^()]*\)', " "))}

    def addr(get: Getter) -> dict[str, Column]:
        v, bare_v = get(f"{prefix}_raw"), get(f"{prefix}_bare")
        angle = F.regexp_extract(bare_v, "<([^<>]*)>", 1)
        phrase = F.trim(F.substring_index(bare_v, "<", 1))
        many = bare_v.rlike(r"[,;]") | bare_v.rlike(r"<[^<>]*>.*<") | (
            bare_v.contains("<") & phrase.contains("@"))
        comment = F.regexp_extract(v, r"\(([^()]*)\)", 1)
        quoted = F.regexp_extract(v, r'"([^"]*)"', 1)
        address = F.when(many, F.lit("")).when(bare_v.contains("<"), angle).otherwise(bare_v)
        name = (
            F.when(many, F.lit(""))
            .when(~bare_v.contains("<"), comment)
            .otherwise(F.trim(F.concat_ws(
                " ", F.when(quoted != "", quoted), F.when(phrase != "", phrase),
                F.when(comment != "", F.concat(F.lit("("), comment, F.lit(")"))))))
        )
        return {
            f"{prefix}_addr": F.regexp_replace(address, r"[ \t\n]+", ""),
            f"{prefix}_name": name,
        }

    return [bare, addr, *address_domain_stages(prefix)]


def address_domain_stages(prefix: str) -> list:
    """Stages from ``<prefix>_addr`` to ``<prefix>_domain``: the registrable
    domain, '' without ``@``."""

    def host(get: Getter) -> dict[str, Column]:
        return {f"{prefix}_host": host_of(F.lower(strip(F.substring_index(get(f"{prefix}_addr"), "@", -1))))}

    def domain(get: Getter) -> dict[str, Column]:
        return {f"{prefix}_domain": F.when(
            get(f"{prefix}_addr").contains("@"), registrable(get(f"{prefix}_host"))).otherwise(F.lit(""))}

    return [host, domain]


def together(*chains: list) -> list:
    """Merge chains of equal length: step i of all chains becomes one stage."""

    def merged(steps: tuple):
        return lambda get: {n: c for step in steps for n, c in step(get).items()}

    return [merged(steps) for steps in zip(*chains, strict=True)]


# --- Authentication ---------------------------------------------------------


def _auth(lowered: Column, protocol: str) -> Column:
    found = F.regexp_extract(lowered, rf"{protocol}=({WORD}+)", 1)
    return F.when(found == "", F.lit("none")).otherwise(found)


def auth_stages() -> list:
    """From ``auth_raw`` and ``received_spf_raw`` to the three results."""

    def results(get: Getter) -> dict[str, Column]:
        low = F.lower(get("auth_raw"))
        spf = _auth(low, "spf")
        older = F.regexp_extract(
            strip(F.lower(get("received_spf_raw"))), "^(pass|fail|softfail|neutral|none)", 1)
        return {
            "spf_result": F.when((spf == "none") & (older != ""), older).otherwise(spf),
            "dkim_result": _auth(low, "dkim"),
            "dmarc_result": _auth(low, "dmarc"),
        }

    def failed(get: Getter) -> dict[str, Column]:
        return {"auth_all_failed": (
            one_of(get("spf_result"), lx.AUTH_FAILED_RESULTS)
            & one_of(get("dkim_result"), lx.AUTH_FAILED_RESULTS)
            & one_of(get("dmarc_result"), lx.AUTH_FAILED_RESULTS))}

    return [results, failed]


# --- The other signals ------------------------------------------------------


def message_id_mismatch(message_id: Column, sender_domain: Column) -> Column:
    """Missing, malformed or local id, or one whose domain lacks the sender's."""
    mid = F.lower(F.regexp_extract(strip(message_id), r"@([\p{L}\p{N}_.\-]+)>?\z", 1))
    return (mid == "") | mid.contains("localhost") | ~mid.contains(sender_domain)


def read_stage(get: Getter) -> dict[str, Column]:
    """Every header the features need, from the column ``head``."""
    head = get("head")
    return {
        "from_raw": header(head, "From"),
        "reply_to_raw": header(head, "Reply-To"),
        "return_path_raw": header(head, "Return-Path"),
        "sender_raw": header(head, "Sender"),
        "auth_raw": header(head, "Authentication-Results"),
        "received_spf_raw": header(head, "Received-SPF"),
        "message_id": header(head, "Message-ID"),
        "mailer": F.lower(F.when(header(head, "X-Mailer") != "", header(head, "X-Mailer"))
                          .otherwise(header(head, "User-Agent"))),
        "received_chain_length": F.regexp_count(head, F.lit(r"(?im)^Received:")),
        "has_script_originating_header": head.rlike(
            "(?im)^(?:" + "|".join(lx.SCRIPT_HEADER_PREFIXES) + ")[!-9;-~]*:"),
    }


def identity_stage(get: Getter) -> dict[str, Column]:
    sender = get("from_domain")
    free = one_of(sender, lx.FREE_MAIL_DOMAINS)
    return {
        "from_returnpath_mismatch": (get("return_path_addr") != "") & (sender != get("return_path_domain")),
        "from_replyto_mismatch": (get("reply_to_addr") != "") & (sender != get("reply_to_domain")),
        "sender_header_mismatch": (get("sender_addr") != "") & (sender != get("sender_domain")),
        "reply_to_is_free_email": one_of(get("reply_to_domain"), lx.FREE_MAIL_DOMAINS),
        "sender_uses_free_email": free,
        "display_name_impersonation": contains_any(F.lower(get("from_name")), lx.OFFICIAL_NAME_KEYWORDS) & free,
        "received_chain_missing": get("received_chain_length") == 0,
        "message_id_domain_mismatch": message_id_mismatch(get("message_id"), sender),
        "suspicious_mailer": contains_any(get("mailer"), lx.SUSPICIOUS_MAILERS),
    }


def header_stages() -> list:
    addresses = [address_stages(p) for p in ("from", "reply_to", "return_path", "sender")]
    return [read_stage, *auth_stages(), *together(*addresses), identity_stage]


def sender_url_mismatch(sender_domain: Column, url_domains: Column) -> Column:
    """No link points to the sender's own domain; false without links."""
    return (F.size(url_domains) > 0) & ~F.array_contains(url_domains, sender_domain)


# --- Attachments ------------------------------------------------------------

MAY_HAVE_FILENAME = r"(?i)name[*0-9]*\s*="


def _extension(name: Column) -> Column:
    return F.when(name.contains("."), F.substring_index(name, ".", -1))


def _inner_extension(name: Column) -> Column:
    """Second label from the right of a name with at least two dots."""
    return F.when(name.rlike(r"\..*\."), F.substring_index(F.substring_index(name, ".", -2), ".", 1))


def attachment_summary(names: Column) -> dict[str, Column]:
    low = F.transform(names, lambda n: F.lower(n))

    def some(test) -> Column:
        return F.exists(low, lambda n: F.coalesce(test(n), F.lit(False)))

    return {
        "num_attachments": F.size(names),
        "has_dangerous_attachment": some(lambda n: one_of(_extension(n), lx.DANGEROUS_EXTENSIONS)),
        "has_macro_attachment": some(lambda n: one_of(_extension(n), lx.MACRO_EXTENSIONS)),
        "has_double_extension_attachment": some(
            lambda n: one_of(_inner_extension(n), lx.DOCUMENT_EXTENSIONS)
            & one_of(_extension(n), lx.DANGEROUS_EXTENSIONS)),
        "attachment_social_keyword_count": F.aggregate(
            low, F.lit(0), lambda acc, n: acc + count_terms(n, lx.ATTACHMENT_KEYWORDS)),
    }
