"""DuckDB counterparts of the registered queries, written on their own: links
and headers are unnested and aggregated, lists replace the string arithmetic,
and regular expressions follow RE2."""

from __future__ import annotations

import re

from ..functions import lexicons as lx
from ..functions.domains import rule_suffixes
from ..operators.report import SIGNAL_TEXTS, VERDICT_TEXTS
from ..sources import generator as G
from .fixtures import FIXTURES, NOTICE, SIGNATURES, SUFFIX_RULES, fixture_sql, rule_nodes

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = "[^" + WS[1:]
WORD_END = r"($|[^\p{L}\p{N}_])"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def hits(column: str, terms) -> str:
    """Number of terms contained in a column."""
    return f"CAST(len(list_filter({sql_list(terms)}, lambda t: contains({column}, t))) AS INT)"


def strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, {q('^' + WS + '+')}, ''), {q(WS + '+$')}, '')"


def rounded(expr: str, digits: int) -> str:
    """Correct rounding of the binary value, as a formatter does it."""
    return f"CAST(format('{{:.{digits}f}}', {expr}) AS DOUBLE)"


BRANDS = [d.split(".")[0] for d in lx.KNOWN_ENTITY_DOMAINS]

LEAKS = [
    (rf"sure,?{WS}+here{WS}+is{WS}+(an?{WS}+)?email", 1),
    (rf"as an ai{WORD_END}", 0),
    (r"i cannot (assist|help) with that", 1),
    (r"\[insert (company|name|recipient)[^\]]*\]", 1),
    (r"\{\{[^\n]*?\}\}", 0),
    (r"as a large language model", 0),
    (r"i'm sorry,? but i can't", 0),
]
EXCUSES = [
    (r"on a plane", 0), (r"in-?flight wi-?fi", 0), (r"no cellular service", 0),
    (r"can'?t (take|answer) calls", 1), (r"unable to (verify|confirm) (by|via) phone", 1),
    (r"in a meeting all day", 0), (r"limited connectivity", 0), (r"traveling and", 0),
    (r"before we land", 0), (r"through this email only", 0),
]
URL = r"""(https?://[^\s<>"']+|www\.[^\s<>"']+)"""


def match_count(column: str, patterns) -> str:
    return " + ".join(f"CAST(regexp_matches({column}, {q(p)}) AS INT)" for p, _ in patterns)


CTES: dict[str, str] = {name: fixture_sql(name) for name in FIXTURES}

# --- Links ------------------------------------------------------------------

CTES["mail_url"] = f"""
SELECT mail_id, CAST(generate_subscripts(u, 1) - 1 AS INT) AS pos, unnest(u) AS url
FROM (SELECT mail_id, regexp_extract_all(body_text, {q(URL)}, 1) AS u FROM mail)"""
CTES["page_url"] = f"""
SELECT page_id, CAST(-1 AS INT) AS pos, url FROM pages
UNION ALL
SELECT page_id, CAST(generate_subscripts(u, 1) - 1 AS INT), unnest(u)
FROM (SELECT page_id, regexp_extract_all(html, {q(URL)}, 1) AS u FROM pages)"""
CTES["any_url"] = """
SELECT 'mail' AS origin, mail_id AS owner_id, pos, url FROM mail_url
UNION ALL SELECT 'page', page_id, pos, url FROM page_url"""
CTES["any_url_parts"] = """
SELECT *, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN lower(split_part(url, '://', 1)) ELSE 'http' END AS scheme,
  lower(rtrim(split_part(list_last(string_split(authority, '@')), ':', 1), '.')) AS host,
  regexp_replace(regexp_extract(substr(rest, length(authority) + 1), '^[^?#]*'), ';[^/]*$', '') AS path
FROM (SELECT *, regexp_extract(rest, '^[^/?#]*') AS authority
      FROM (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE url END AS rest FROM any_url))"""


def domain_sql(source: str, host: str) -> str:
    """Label lists instead of string cuts: n labels, the last k are the suffix."""
    return f"""
SELECT * EXCLUDE (labels, n, k),
  array_to_string(labels[n - k + 1 : n], '.') AS suffix,
  CASE WHEN is_ip_address THEN {host} WHEN k = n THEN '' ELSE labels[n - k] END AS domain,
  CASE WHEN is_ip_address THEN '' ELSE array_to_string(labels[1 : n - k - 1], '.') END AS subdomain,
  (CASE WHEN is_ip_address THEN {host} WHEN k = n THEN '' ELSE labels[n - k] END) || '.'
     || array_to_string(labels[n - k + 1 : n], '.') AS full_domain
FROM (
  SELECT *, CASE WHEN is_ip_address THEN 0
      WHEN n >= 2 AND list_contains({sql_list(rule_suffixes())}, labels[n - 1] || '.' || labels[n]) THEN 2
      WHEN n >= 2 AND NOT regexp_full_match(labels[n], '[0-9]+') THEN 1
      WHEN n = 1 AND regexp_full_match(labels[1], '[a-z][a-z]') THEN 1 ELSE 0 END AS k
  FROM (
    SELECT *, len(labels) AS n,
      len(labels) = 4 AND len(list_filter(labels, lambda x: regexp_full_match(x, '0|[1-9][0-9]?[0-9]?')
          AND coalesce(try_cast(x AS INT), 999) <= 255)) = 4 AS is_ip_address
    FROM (SELECT *, string_split({host}, '.') AS labels FROM {source})))"""


CTES["any_url_domain"] = domain_sql("any_url_parts", "host")
CTES["any_url_features"] = f"""
SELECT *, CAST(length(url) AS INT) AS url_length,
  CAST(len(string_split(url, '.')) - 1 AS INT) AS num_dots,
  CAST(len(string_split(url, '-')) - 1 AS INT) AS num_hyphens,
  CAST(len(string_split(url, '@')) - 1 AS INT) AS num_at_symbols,
  CAST(len(regexp_extract_all(url, '\\p{{Nd}}')) AS INT) AS num_digits,
  CAST(len(string_split(url, '%')) - 1 AS INT) AS num_percent_encoded_chars,
  CAST(CASE WHEN subdomain = '' THEN 0 ELSE len(string_split(subdomain, '.')) END AS INT) AS subdomain_level,
  CAST(len(string_split(path, '/')) - 1 AS INT) AS path_level,
  starts_with(lower(url), 'https://') AS has_https,
  full_domain IN {in_list(lx.SHORTENER_DOMAINS)} AS is_shortened,
  suffix IN {in_list(lx.SUSPICIOUS_TLDS)} AS suspicious_tld,
  contains(url, '@') AS has_at_symbol_trick,
  contains(path, '//') AS has_double_slash_in_path,
  regexp_matches(url, '[A-Za-z0-9._%+-]+%40[A-Za-z0-9.-]+') OR regexp_matches(url, 'email=[^&]*%40')
    OR regexp_matches(path, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') AS has_email_in_url,
  length(url) <> strlen(url) AS has_homograph_chars,
  CAST(len(list_filter({sql_list(lx.URL_IMPERSONATION_KEYWORDS)},
    lambda k: contains(subdomain, k) OR contains(domain, k))) AS INT) AS impersonation_keyword_count,
  len(list_filter({sql_list(BRANDS)}, lambda b: base <> b AND (list_contains(words, b)
    OR len(list_filter(list_append(words, base), lambda w: w <> '' AND levenshtein(w, b) BETWEEN 1 AND 2)) > 0))) > 0
    AS is_typosquat
FROM (SELECT *, split_part(full_domain, '.', 1) AS base, string_split(split_part(full_domain, '.', 1), '-') AS words
      FROM any_url_domain)"""

URL_NUMERIC = ["url_length", "num_dots", "num_hyphens", "num_at_symbols", "num_digits", "subdomain_level",
               "path_level", "impersonation_keyword_count", "num_percent_encoded_chars"]
URL_BOOLEAN = ["is_ip_address", "is_shortened", "suspicious_tld", "has_at_symbol_trick",
               "has_double_slash_in_path", "has_email_in_url", "is_typosquat", "has_homograph_chars"]
CTES["url_agg"] = f"""
SELECT m.mail_id, CAST(count(u.url) AS INT) AS num_urls,
  {", ".join(f"coalesce(max(u.{c}), 0) AS {c}" for c in URL_NUMERIC)},
  {", ".join(f"coalesce(bool_or(u.{c}), false) AS {c}" for c in URL_BOOLEAN)},
  coalesce(bool_and(u.has_https), true) AS has_https
FROM mail AS m LEFT JOIN (SELECT * FROM any_url_features WHERE origin = 'mail') AS u ON u.owner_id = m.mail_id
GROUP BY m.mail_id"""

# --- Headers ----------------------------------------------------------------

CTES["hdr"] = r"""
SELECT mail_id, CAST(pos - 1 AS INT) AS pos, lower(split_part(line, ':', 1)) AS name,
  trim(substr(line, instr(line, ':') + 1)) AS value
FROM (
  SELECT mail_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line
  FROM (
    SELECT mail_id, string_split(regexp_replace(split_part(
        replace(replace(raw_email_source, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
        chr(10) || chr(10), 1), '\n[ \t]+', ' ', 'g'), chr(10)) AS lines
    FROM mail))"""
_WANTED = {
    "from": "from_raw", "reply-to": "reply_to_raw", "return-path": "return_path_raw", "sender": "sender_raw",
    "authentication-results": "auth_raw", "received-spf": "received_spf", "message-id": "message_id",
    "x-mailer": "x_mailer", "user-agent": "user_agent",
}
CTES["hdr_first"] = f"""
SELECT mail_id,
  {", ".join(f"coalesce(arg_min(value, pos) FILTER (WHERE name = {q(k)}), '') AS {v}" for k, v in _WANTED.items())},
  CAST(count(*) FILTER (WHERE name = 'received') AS INT) AS received_chain_length,
  bool_or(starts_with(name, 'x-php') OR starts_with(name, 'x-originating-script')) AS has_script_originating_header
FROM hdr GROUP BY mail_id"""
CTES["addr_raw"] = """
SELECT mail_id, kind, v, regexp_replace(v, '"[^"]*"', '', 'g') AS bare
FROM (SELECT mail_id, 'from' AS kind, from_raw AS v FROM hdr_first
      UNION ALL SELECT mail_id, 'reply_to', reply_to_raw FROM hdr_first
      UNION ALL SELECT mail_id, 'return_path', return_path_raw FROM hdr_first
      UNION ALL SELECT mail_id, 'sender', sender_raw FROM hdr_first)"""
CTES["addr_host"] = r"""
SELECT *, CASE WHEN contains(addr, '@') THEN lower(list_last(string_split(addr, '@'))) ELSE '' END AS addr_host
FROM (
  SELECT mail_id, kind,
    CASE WHEN contains(bare, ',') THEN '' WHEN contains(bare, '<') THEN regexp_extract(bare, '<([^>]*)>', 1)
      ELSE trim(regexp_replace(bare, '\(.*\)', '')) END AS addr,
    CASE WHEN contains(bare, ',') THEN '' WHEN NOT contains(bare, '<') THEN regexp_extract(v, '\((.*)\)', 1)
      WHEN contains(v, '"') THEN regexp_extract(v, '"([^"]*)"', 1) ELSE trim(split_part(v, '<', 1)) END AS name
  FROM addr_raw)"""
CTES["addr_domain"] = domain_sql("addr_host", "addr_host")
CTES["addr"] = """
SELECT mail_id, kind, addr, name,
  CASE WHEN contains(addr, '@') THEN full_domain ELSE '' END AS domain
FROM addr_domain"""
CTES["addr_wide"] = "\nSELECT mail_id,\n  " + ", ".join(
    f"max(addr) FILTER (WHERE kind = '{k}') AS {k}_addr, max(name) FILTER (WHERE kind = '{k}') AS {k}_name, "
    f"max(domain) FILTER (WHERE kind = '{k}') AS {k}_domain"
    for k in ("from", "reply_to", "return_path", "sender")) + "\nFROM addr GROUP BY mail_id"
CTES["auth"] = r"""
SELECT mail_id, CASE WHEN spf = 'none' AND older <> '' THEN older ELSE spf END AS spf_result, dkim AS dkim_result, dmarc AS dmarc_result,
  (CASE WHEN spf = 'none' AND older <> '' THEN older ELSE spf END) IN ('fail', 'softfail', 'none')
    AND dkim IN ('fail', 'softfail', 'none') AND dmarc IN ('fail', 'softfail', 'none') AS auth_all_failed
FROM (SELECT mail_id,
  coalesce(nullif(regexp_extract(lower(auth_raw), 'spf=([\p{L}\p{N}_]+)', 1), ''), 'none') AS spf,
  coalesce(nullif(regexp_extract(lower(auth_raw), 'dkim=([\p{L}\p{N}_]+)', 1), ''), 'none') AS dkim,
  coalesce(nullif(regexp_extract(lower(auth_raw), 'dmarc=([\p{L}\p{N}_]+)', 1), ''), 'none') AS dmarc,
  regexp_extract(lower(trim(received_spf)), '^(pass|fail|softfail|neutral|none)', 1) AS older
  FROM hdr_first)"""
CTES["hdr_features"] = rf"""
SELECT h.mail_id, a.from_addr, a.from_name, a.from_domain, t.spf_result, t.dkim_result, t.dmarc_result, t.auth_all_failed,
  a.return_path_addr <> '' AND a.from_domain <> a.return_path_domain AS from_returnpath_mismatch,
  a.reply_to_addr <> '' AND a.from_domain <> a.reply_to_domain AS from_replyto_mismatch,
  a.reply_to_domain IN {in_list(lx.FREE_MAIL_DOMAINS)} AS reply_to_is_free_email,
  a.sender_addr <> '' AND a.from_domain <> a.sender_domain AS sender_header_mismatch,
  a.from_domain IN {in_list(lx.FREE_MAIL_DOMAINS)} AS sender_uses_free_email,
  {hits("lower(a.from_name)", lx.OFFICIAL_NAME_KEYWORDS)} > 0
    AND a.from_domain IN {in_list(lx.FREE_MAIL_DOMAINS)} AS display_name_impersonation,
  coalesce(u.n > 0 AND NOT u.own, false) AS sender_url_domain_mismatch,
  h.received_chain_length, h.received_chain_length = 0 AS received_chain_missing,
  CASE WHEN NOT regexp_matches(trim(h.message_id), '@[\p{{L}}\p{{N}}_.-]+>?$') THEN true
    WHEN contains(mid, 'localhost') THEN true ELSE NOT contains(mid, a.from_domain) END AS message_id_domain_mismatch,
  {hits("lower(CASE WHEN h.x_mailer <> '' THEN h.x_mailer ELSE h.user_agent END)", lx.SUSPICIOUS_MAILERS)} > 0
    AS suspicious_mailer,
  h.has_script_originating_header
FROM (SELECT *, lower(regexp_extract(trim(message_id), '@([\p{{L}}\p{{N}}_.-]+)>?$', 1)) AS mid FROM hdr_first) AS h
JOIN addr_wide AS a ON a.mail_id = h.mail_id
JOIN auth AS t ON t.mail_id = h.mail_id
LEFT JOIN (
  SELECT x.owner_id, count(*) AS n, bool_or(x.full_domain = w.from_domain) AS own
  FROM any_url_domain AS x JOIN addr_wide AS w ON w.mail_id = x.owner_id AND x.origin = 'mail'
  GROUP BY x.owner_id) AS u ON u.owner_id = h.mail_id"""
CTES["att"] = f"""
SELECT m.mail_id, CAST(count(f.name) AS INT) AS num_attachments,
  coalesce(bool_or(len(f.parts) >= 2 AND f.parts[-1] IN {in_list(lx.DANGEROUS_EXTENSIONS)}), false) AS has_dangerous_attachment,
  coalesce(bool_or(len(f.parts) >= 2 AND f.parts[-1] IN {in_list(lx.MACRO_EXTENSIONS)}), false) AS has_macro_attachment,
  coalesce(bool_or(len(f.parts) >= 3 AND f.parts[-2] IN {in_list(lx.DOCUMENT_EXTENSIONS)}
    AND f.parts[-1] IN {in_list(lx.DANGEROUS_EXTENSIONS)}), false) AS has_double_extension_attachment,
  CAST(coalesce(sum({hits("f.name", lx.ATTACHMENT_KEYWORDS)}), 0) AS INT) AS attachment_social_keyword_count
FROM mail AS m LEFT JOIN (
  SELECT mail_id, name, string_split(name, '.') AS parts
  FROM (SELECT mail_id, unnest(regexp_extract_all(lower(raw_email_source), 'filename="([^"]*)"', 1)) AS name FROM mail)
) AS f ON f.mail_id = m.mail_id
GROUP BY m.mail_id"""

# --- Text -------------------------------------------------------------------

CTES["sentence"] = rf"""
SELECT mail_id, generate_subscripts(s, 1) AS no, unnest(s) AS sentence
FROM (SELECT mail_id, list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(body_text,
      '(^|[^\p{{L}}\p{{N}}_])(Mr|Mrs|Ms|Dr|Inc|Ltd|e\.g|i\.e)\.', '\1\2<DOT>', 'g'),
      {q('([.!?])' + WS + '+')}, '\1' || chr(1), 'g'), chr(1)),
    lambda x: {strip("replace(x, '<DOT>', '.')")}), lambda x: x <> '') AS s FROM mail)"""
CTES["lengths"] = f"""
SELECT mail_id, count(*) AS n, sum(w) AS s, sum(w * w) AS sq
FROM (SELECT mail_id, CAST(len(regexp_extract_all(sentence, {q(NOT_WS + '+')})) AS BIGINT) AS w FROM sentence)
GROUP BY mail_id"""
CTES["txt"] = f"""
SELECT mail_id, lowered, sentence_count, word_count, burstiness_score, burstiness_score < 0.35 AS low_burstiness_flag,
  llm_trope_word_count, llm_trope_phrase_count, prompt_leakage_detected, out_of_band_excuse_count,
  urgency_word_count, financial_action_word_count,
  urgency_word_count > 0 AND financial_action_word_count > 0 AS urgency_financial_combo,
  causal_connective_count, personal_osint_word_count,
  personal_osint_word_count > 0 AND financial_action_word_count > 0 AS personalization_financial_mismatch
FROM (
  SELECT m.mail_id, lowered, CAST(coalesce(l.n, 0) AS INT) AS sentence_count,
    CAST(len(regexp_extract_all(m.body_text, '[a-zA-Z'']+')) AS INT) AS word_count,
    CASE WHEN coalesce(l.n, 0) < 3 THEN 1.0 ELSE {rounded('sqrt(CAST(l.n * l.sq - l.s * l.s AS DOUBLE)) / l.s', 3)} END AS burstiness_score,
    {hits("lowered", lx.TROPE_WORDS)} AS llm_trope_word_count,
    {hits("lowered", lx.TROPE_PHRASES)} AS llm_trope_phrase_count,
    ({match_count("lowered", LEAKS)}) > 0 AS prompt_leakage_detected,
    {match_count("lowered", EXCUSES)} AS out_of_band_excuse_count,
    {hits("lowered", lx.URGENCY_TERMS)} AS urgency_word_count,
    {hits("lowered", lx.FINANCIAL_TERMS)} AS financial_action_word_count,
    {hits("lowered", lx.CAUSAL_TERMS)} AS causal_connective_count,
    {hits("lowered", lx.PERSONAL_TERMS)} AS personal_osint_word_count
  FROM (SELECT mail_id, body_text, lower(body_text) AS lowered FROM mail) AS m LEFT JOIN lengths AS l ON l.mail_id = m.mail_id)"""

URL_NAMES = ["num_urls", *URL_NUMERIC, *URL_BOOLEAN, "has_https"]
HEADER_NAMES = [
    "spf_result", "dkim_result", "dmarc_result", "auth_all_failed", "from_returnpath_mismatch",
    "from_replyto_mismatch", "reply_to_is_free_email", "sender_header_mismatch", "sender_uses_free_email",
    "display_name_impersonation", "sender_url_domain_mismatch", "received_chain_length", "received_chain_missing",
    "message_id_domain_mismatch", "suspicious_mailer", "has_script_originating_header"]
ATT_NAMES = ["num_attachments", "has_dangerous_attachment", "has_macro_attachment",
             "has_double_extension_attachment", "attachment_social_keyword_count"]
TEXT_NAMES = [
    "sentence_count", "word_count", "burstiness_score", "low_burstiness_flag", "llm_trope_word_count",
    "llm_trope_phrase_count", "prompt_leakage_detected", "out_of_band_excuse_count", "urgency_word_count",
    "financial_action_word_count", "urgency_financial_combo", "causal_connective_count",
    "personal_osint_word_count", "personalization_financial_mismatch"]
_KEEP_TYPE = {"spf_result", "dkim_result", "dmarc_result", "burstiness_score"}


def _prefixed(alias: str, prefix: str, names: list[str]) -> str:
    return ", ".join(f"{alias}.{n} AS {prefix}__{n}" if n in _KEEP_TYPE else f"CAST({alias}.{n} AS INT) AS {prefix}__{n}"
                     for n in names)


CTES["wide"] = f"""
SELECT m.mail_id, m.label, h.from_addr, h.from_domain,
  {_prefixed("u", "url", URL_NAMES)}, {_prefixed("h", "header", HEADER_NAMES)},
  {_prefixed("a", "header", ATT_NAMES)}, {_prefixed("t", "text", TEXT_NAMES)}
FROM mail AS m JOIN url_agg AS u ON u.mail_id = m.mail_id JOIN hdr_features AS h ON h.mail_id = m.mail_id
JOIN att AS a ON a.mail_id = m.mail_id JOIN txt AS t ON t.mail_id = m.mail_id"""
WIDE_NAMES = ([f"url__{n}" for n in URL_NAMES] + [f"header__{n}" for n in HEADER_NAMES + ATT_NAMES]
              + [f"text__{n}" for n in TEXT_NAMES])
ONE_HOT = {f"header__{c}_{v}": (f"header__{c}", v) for c in ("spf_result", "dkim_result", "dmarc_result")
           for v in lx.AUTH_VOCABULARY}
CTES["one_hot"] = ("\nSELECT * EXCLUDE (header__spf_result, header__dkim_result, header__dmarc_result), "
                   + ", ".join(f"CAST({c} = {q(v)} AS INT) AS {n}" for n, (c, v) in ONE_HOT.items()) + " FROM wide")
MODEL_NAMES = [n for n in WIDE_NAMES if not n.endswith(("spf_result", "dkim_result", "dmarc_result"))] + list(ONE_HOT)

# --- Posts ------------------------------------------------------------------


def _tier(score: str, top: str) -> str:
    return f"CASE WHEN {score} < 0.3 THEN 'SAFE' WHEN {score} < 0.7 THEN 'SUSPICIOUS' ELSE {q(top)} END"


CTES["behaviour"] = f"""
SELECT *, CAST(very_new_account AS INT) + CAST(abnormal_posting_frequency AS INT) + CAST(suspicious_follow_ratio AS INT)
    + CAST(suspicious_handle_pattern AS INT) + CAST(suspicious_bio_keyword_count > 0 AS INT) AS behavioral_red_flag_count
FROM (
  SELECT *, coalesce(account_age_days < 30, false) AS very_new_account,
    coalesce(posts_per_day > 20, false) AS abnormal_posting_frequency,
    {rounded('ratio', 3)} AS follower_following_ratio,
    coalesce(following > 500 AND ratio < 0.05, false) AS suspicious_follow_ratio,
    coalesce(regexp_matches(handle, '[0-9]{{6,}}') OR regexp_matches(handle, '^(user|account)[0-9]+$')
      OR regexp_matches(handle, '_{{3,}}'), false) AS suspicious_handle_pattern,
    CASE WHEN bio_text IS NULL THEN 0 ELSE {hits("lower(bio_text)", lx.BIO_KEYWORDS)} END AS suspicious_bio_keyword_count
  FROM (SELECT *, CAST(date_diff('day', try_cast(account_created_date AS DATE), DATE '2024-02-01') AS INT) AS account_age_days,
          CASE WHEN following <> 0 THEN followers / CAST(following AS DOUBLE) END AS ratio FROM post))"""
CTES["post_txt"] = f"""
SELECT post_id, {match_count("lowered", LEAKS)} AS leaks, {match_count("lowered", EXCUSES)} AS excuses,
  {hits("lowered", lx.URGENCY_TERMS)} AS urgency, {hits("lowered", lx.FINANCIAL_TERMS)} AS money,
  {hits("lowered", lx.PERSONAL_TERMS)} AS personal, {hits("lowered", lx.TROPE_WORDS)} AS tropes,
  CASE WHEN len(w) < 3 THEN false ELSE
    {rounded("sqrt(CAST(len(w) * list_sum(list_transform(w, lambda x: x * x)) - list_sum(w) * list_sum(w) AS DOUBLE)) / list_sum(w)", 3)} < 0.35
    END AS monotone
FROM (SELECT post_id, lower(post_text) AS lowered, list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(post_text, '(^|[^\\p{{L}}\\p{{N}}_])(Mr|Mrs|Ms|Dr|Inc|Ltd|e\\.g|i\\.e)\\.', '\\1\\2<DOT>', 'g'),
      {q('([.!?])' + WS + '+')}, '\\1' || chr(1), 'g'), chr(1)),
    lambda x: CAST(len(regexp_extract_all(x, {q(NOT_WS + '+')})) AS BIGINT)), lambda n: n > 0) AS w FROM post)"""
CTES["post_risk"] = """
SELECT t.post_id, least(
    CASE WHEN urgency > 0 AND money > 0 THEN 0.35e0 ELSE 0e0 END
  + CASE WHEN personal > 0 AND money > 0 THEN 0.35e0 ELSE 0e0 END
  + CASE WHEN leaks > 0 THEN 0.15e0 ELSE 0e0 END + CASE WHEN excuses > 0 THEN 0.10e0 ELSE 0e0 END
  + CASE WHEN monotone THEN 0.03e0 ELSE 0e0 END + CASE WHEN tropes > 2 THEN 0.02e0 ELSE 0e0 END, 1e0) AS text_risk,
  least(b.behavioral_red_flag_count / 5e0, 1e0) AS account_risk, b.image_applicable,
  CASE WHEN b.image_applicable THEN coalesce(b.image_fake_probability, 0e0) ELSE 0e0 END AS image_risk,
  CASE WHEN b.image_applicable THEN 0.3e0 ELSE 0e0 END AS image_weight
FROM post_txt AS t JOIN behaviour AS b ON b.post_id = t.post_id"""
CTES["post_fused"] = """
SELECT *, (text_risk * 0.4e0 + image_risk * image_weight + account_risk * 0.3e0) / (0.4e0 + image_weight + 0.3e0) AS fused
FROM post_risk"""

# --- Registry, media --------------------------------------------------------

CTES["communication_hashed"] = f"SELECT *, sha256({strip('content')}) AS content_hash FROM communication"
CTES["executive"] = """
SELECT x.executive_name, arg_min(e.entity_name, e.id) AS entity_name
FROM entity_executive AS x JOIN entity AS e ON e.id = x.entity_id GROUP BY x.executive_name"""
CTES["exec_claim"] = f"""
SELECT c.claim_id, c.claimed_speaker_name,
  CASE WHEN c.claimed_speaker_name <> '' THEN x.executive_name IS NOT NULL END AS executive_authorized,
  x.entity_name AS executive_entity,
  CASE WHEN c.claimed_speaker_name <> '' THEN coalesce('PASSED (Authorized under ' || x.entity_name || ')',
    'FAILED (Not an authorized executive)') END AS executive_status
FROM claim AS c LEFT JOIN executive AS x ON x.executive_name = {strip('c.claimed_speaker_name')}"""


def _verdict(top: str, positive: str, empty: str) -> str:
    return f"""
SELECT m.media_id, coalesce({rounded('u.median', 4)}, 0e0) AS fake_probability,
  CASE WHEN u.n IS NULL THEN '{empty}' WHEN u.median < 0.3 THEN 'SAFE' WHEN u.median < 0.7 THEN 'SUSPICIOUS' ELSE '{top}' END AS risk_tier,
  CASE WHEN u.n IS NULL THEN 'unable_to_assess' WHEN u.median >= 0.5 THEN '{positive}' ELSE 'authentic' END AS prediction,
  coalesce(u.n, 0) AS num_units_analyzed
FROM media AS m LEFT JOIN (
  SELECT media_id, median(fake_probability) AS median, count(*) AS n FROM media_unit GROUP BY media_id) AS u
  ON u.media_id = m.media_id"""


CTES["video_verdict"] = _verdict("DEEPFAKE", "deepfake", "NO_FACE_DETECTED")
CTES["audio_verdict"] = _verdict("SYNTHETIC", "synthetic", "NO_AUDIO_DETECTED")

# --- Generated mails --------------------------------------------------------


def _h(slot: str, *keys: str) -> str:
    text = " || '|' || ".join([f"CAST({k} AS VARCHAR)" for k in keys] + [q(slot)])
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def _pick(pool, slot: str, *keys: str) -> str:
    return f"{sql_list(pool)}[{_h(slot, *keys)} % {len(pool)} + 1]"


def _spoof(real: str, *keys: str) -> str:
    base = f"split_part({real}, '.', 1)"
    at = f"({_h('swap', *keys)} % greatest(length({base}) - 2, 1) + 1)"
    kind = f"({_h('kind', *keys)} % 4)"
    return f"""(CASE WHEN {kind} = 0 THEN substr({base}, 1, length({base}) // 2) || '-' || substr({base}, length({base}) // 2 + 1)
  WHEN {kind} = 1 AND length({base}) > 3 THEN substr({base}, 1, {at}) || substr({base}, {at} + 2, 1)
    || substr({base}, {at} + 1, 1) || substr({base}, {at} + 3)
  WHEN {kind} = 2 THEN {base} || {_pick(G.SPOOF_WORDS, 'word', *keys)} ELSE {base} END || '.' || {_pick(G.SPOOF_TLDS, 'tld', *keys)})"""


def _number(slot: str, low: int, high: int, *keys: str) -> str:
    return f"({_h(slot, *keys)} % {high - low + 1} + {low})"


def _fake_url(*keys: str) -> str:
    parts = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"""CASE style WHEN 'typosquat' THEN 'https://' || spoofed || '/case/' || {_number('case', 10, 99999, *keys)} || '/review'
  WHEN 'ip_address' THEN 'http://' || {_number('a', 11, 223, *keys)} || '.' || {_number('b', 1, 250, *keys)} || '.'
    || {_number('c', 1, 250, *keys)} || '.' || {_number('d', 1, 250, *keys)} || '/form'
  WHEN 'shortener' THEN 'https://' || {_pick(G.SHORTENERS, 'shortener', *keys)} || '/' || substr(md5({parts}), 1, 6)
  WHEN 'email_embedded' THEN 'https://' || spoofed || '/keep?box=' || victim_email
  WHEN 'at_symbol' THEN 'https://' || real || '@' || spoofed || '/units'
  WHEN 'clean' THEN 'https://www.' || real || '/en/notices' ELSE '' END"""


_K = ("seed", "no")
_TEMPLATE_ROWS = ",\n".join(
    f"({i}, {q(t[0])}, {t[1]}, " + ", ".join(q(v) for v in t[2:]) + ")" for i, t in enumerate(G.TEMPLATES))
CTES["generated"] = f"""
SELECT id, label, template_id,
  CASE WHEN label = 1 THEN 'Risky: ' ELSE 'Ordinary: ' END || array_to_string(list_transform(
    string_split(template_id, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS category,
  subject, body_text,
  'Authentication-Results: in.example.org; spf=' || split_part(auth, ' ', 1) || '; dkim=' || split_part(auth, ' ', 2)
  || '; dmarc=' || split_part(auth, ' ', 3) || chr(10) || 'Message-ID: <' || {_h('mid', *_K)} || '@' || from_domain || '>' || chr(10)
  || 'User-Agent: ' || CASE WHEN sender = 'free' THEN 'SwiftMailer' ELSE 'Evolution 3.50' END || chr(10)
  || 'Sender: office@' || from_domain || chr(10) || 'Return-Path: <office@' || from_domain || '>' || chr(10)
  || 'Reply-To: <office@' || from_domain || '>' || chr(10) || 'From: ' || entity || ' office <office@' || from_domain || '>' || chr(10)
  || 'To: <' || victim_email || '>' || chr(10) || 'Subject: ' || subject || chr(10) || chr(10) || body_text || chr(10) AS raw_email_source,
  'made from seed ' || seed AS notes
FROM (
  SELECT *, seed * {len(G.TEMPLATES)} + no AS id,
    replace(replace(replace(replace(replace(subject_t, '{{entity}}', entity), '{{victim}}', victim), '{{amount}}', amount), '{{date}}', date), '{{url}}', url) AS subject,
    replace(replace(replace(replace(replace(body_t, '{{entity}}', entity), '{{victim}}', victim), '{{amount}}', amount), '{{date}}', date), '{{url}}', url) AS body_text
  FROM (
    SELECT *, {_fake_url(*_K)} AS url,
      CASE sender WHEN 'spoof' THEN spoofed WHEN 'free' THEN {_pick(G.FREE_DOMAINS, 'free', *_K)} ELSE real END AS from_domain
    FROM (
      SELECT *, first || ' ' || last AS victim, {_spoof('real', *_K)} AS spoofed,
        lower(first || '.' || last || '@example.com') AS victim_email
      FROM (
        SELECT *, {sql_list([e for e, _ in G.ENTITIES])}[{_h('entity', *_K)} % {len(G.ENTITIES)} + 1] AS entity,
          {sql_list([d for _, d in G.ENTITIES])}[{_h('entity', *_K)} % {len(G.ENTITIES)} + 1] AS real,
          {_pick(G.FIRST_NAMES, 'first', *_K)} AS first, {_pick(G.LAST_NAMES, 'last', *_K)} AS last,
          {_pick(G.AMOUNTS, 'amount', *_K)} AS amount, {_pick(G.DATES, 'date', *_K)} AS date
        FROM (SELECT c_custkey AS seed FROM customer),
          (VALUES {_TEMPLATE_ROWS}) AS t(no, template_id, label, style, sender, auth, subject_t, body_t)))))"""


def with_ctes(select: str) -> str:
    """Prefix a select with the sub-queries it needs, in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for word in set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text)):
            if word in CTES and word not in needed:
                needed.add(word)
                visit(CTES[word])

    visit(select)
    if not needed:
        return select
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in CTES if name in needed)
    return f"WITH {parts}\n{select}"


# --- One select per registered query ----------------------------------------

SELECTS: dict[str, str] = {}

SELECTS["url_find"] = "SELECT mail_id, pos, url FROM mail_url"
SELECTS["url_parts"] = "SELECT origin, owner_id, pos, url, scheme, host, path FROM any_url_parts"
SELECTS["url_domain"] = "SELECT origin, owner_id, pos, host, subdomain, domain, suffix, full_domain FROM any_url_domain"
# The number of suffix labels of each host, rule by rule.
SELECTS["url_domain_rules"] = f"""
SELECT origin, owner_id, pos, host, CASE WHEN ip THEN '' ELSE array_to_string(l[n - k + 1 : n], '.') END AS suffix,
  CASE WHEN ip THEN host WHEN n > k THEN l[n - k] ELSE '' END AS domain, CASE WHEN ip THEN '' ELSE array_to_string(l[1 : greatest(n - k - 1, 0)], '.') END AS subdomain,
  CASE WHEN ip THEN host || '.' WHEN n > k THEN l[n - k] || '.' || array_to_string(l[n - k + 1 : n], '.') ELSE '.' || array_to_string(l[n - k + 1 : n], '.') END AS full_domain
FROM (SELECT *, coalesce(
        (SELECT max(j) - 1 FROM range(1, n + 1) AS s(j) WHERE list_contains(r, '!' || array_to_string(l[n - j + 1 : n], '.'))),
        (SELECT max(j) FROM range(1, n + 1) AS s(j) WHERE list_contains(r, array_to_string(l[n - j + 1 : n], '.'))
            OR (j > 1 AND list_contains(r, '*.' || array_to_string(l[n - j + 2 : n], '.')))), 1) AS k
      FROM (SELECT origin, owner_id, pos, host, string_split(host, '.') AS l, len(string_split(host, '.')) AS n,
              regexp_full_match(host, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\\.|$)){{4}}') AND NOT ends_with(host, '.') AS ip,
              {sql_list(SUFFIX_RULES)} AS r FROM any_url_parts))"""
SELECTS["url_lexical"] = """SELECT origin, owner_id, pos, url_length, num_dots, num_hyphens, num_at_symbols, num_digits,
  num_percent_encoded_chars, subdomain_level, path_level FROM any_url_features"""
SELECTS["url_flags"] = """SELECT origin, owner_id, pos, is_ip_address, has_https, is_shortened, suspicious_tld,
  has_at_symbol_trick, has_double_slash_in_path, has_email_in_url, has_homograph_chars FROM any_url_features"""
SELECTS["url_impersonation"] = "SELECT origin, owner_id, pos, impersonation_keyword_count FROM any_url_features"
SELECTS["url_typosquat"] = "SELECT origin, owner_id, pos, full_domain, is_typosquat FROM any_url_features"
SELECTS["url_typosquat_registry"] = f"""
SELECT origin, owner_id, pos, full_domain, coalesce(bad, false) AS is_typosquat FROM any_url_domain
LEFT JOIN (
  SELECT base, bool_or(b <> base) AS bad
  FROM (SELECT base, unnest(list_append(string_split(base, '-'), base)) AS w
        FROM (SELECT DISTINCT split_part(full_domain, '.', 1) AS base FROM any_url_domain))
  JOIN (SELECT DISTINCT split_part(domain, '.', 1) AS b FROM (SELECT domain FROM entity_domain
        UNION ALL SELECT unnest({sql_list(lx.KNOWN_ENTITY_DOMAINS)}))) ON w <> '' AND b <> '' AND levenshtein(w, b) <= 2
  GROUP BY base) ON base = split_part(full_domain, '.', 1)"""
SELECTS["url_agg"] = "SELECT * FROM url_agg"
SELECTS["url_agg_rows"] = "SELECT * FROM url_agg WHERE num_urls > 0"

SELECTS["hdr_explode"] = "SELECT mail_id, pos, name, value FROM hdr"
SELECTS["hdr_address"] = "SELECT mail_id, kind, addr, name, domain FROM addr"
SELECTS["hdr_auth"] = "SELECT mail_id, spf_result, dkim_result, dmarc_result, auth_all_failed FROM auth"
SELECTS["hdr_mismatch"] = """SELECT mail_id, from_returnpath_mismatch, from_replyto_mismatch, sender_header_mismatch,
  reply_to_is_free_email, sender_uses_free_email FROM hdr_features"""
SELECTS["hdr_url_mismatch"] = "SELECT mail_id, from_domain, sender_url_domain_mismatch FROM hdr_features"
SELECTS["hdr_impersonation"] = "SELECT mail_id, from_name, display_name_impersonation FROM hdr_features"
SELECTS["hdr_received"] = "SELECT mail_id, received_chain_length, received_chain_missing FROM hdr_features"
SELECTS["hdr_message_id"] = "SELECT mail_id, message_id_domain_mismatch FROM hdr_features"
SELECTS["hdr_mailer"] = "SELECT mail_id, suspicious_mailer, has_script_originating_header FROM hdr_features"
SELECTS["att_flags"] = "SELECT * FROM att"

SELECTS["txt_sentences"] = "SELECT mail_id, CAST(no - 1 AS INT) AS no, sentence FROM sentence"
SELECTS["txt_structure"] = "SELECT mail_id, sentence_count, word_count FROM txt"
SELECTS["txt_burstiness"] = "SELECT mail_id, burstiness_score, low_burstiness_flag FROM txt"
SELECTS["txt_lexicon"] = """SELECT mail_id, llm_trope_word_count, llm_trope_phrase_count, urgency_word_count,
  financial_action_word_count, causal_connective_count, personal_osint_word_count FROM txt"""
SELECTS["txt_patterns"] = "SELECT mail_id, prompt_leakage_detected, out_of_band_excuse_count FROM txt"
SELECTS["txt_combos"] = "SELECT mail_id, urgency_financial_combo, personalization_financial_mismatch FROM txt"


def _evidence() -> str:
    def terms(category: str, values) -> str:
        return (f"SELECT mail_id, '{category}' AS category, array_to_string(list_filter("
                f"{sql_list(sorted(values))}, lambda t: contains(lowered, t)), '|') AS matches FROM txt")

    def patterns(category: str, values) -> str:
        parts = []
        for p, g in values:
            found = f"regexp_extract_all(lowered, {q(p.replace(WORD_END, ''))}, {g})"
            if WORD_END in p:
                word = p.replace(WORD_END, "")
                found = (f"list_transform(regexp_extract_all(lowered, {q(p)}), lambda x: {q(word)})")
            parts.append(found)
        joined = "list_concat(" + ", ".join(parts) + ")"
        return f"SELECT mail_id, '{category}' AS category, array_to_string({joined}, '|') AS matches FROM txt"

    tropes = (f"SELECT mail_id, 'llm_tropes' AS category, array_to_string(list_concat(list_filter("
              f"{sql_list(sorted(lx.TROPE_WORDS))}, lambda t: contains(lowered, t)), list_filter("
              f"{sql_list(sorted(lx.TROPE_PHRASES))}, lambda t: contains(lowered, t))), '|') AS matches FROM txt")
    return " UNION ALL ".join([
        tropes, patterns("prompt_leakage", LEAKS), patterns("out_of_band_excuses", EXCUSES),
        terms("urgency", lx.URGENCY_TERMS), terms("financial", lx.FINANCIAL_TERMS),
        terms("causal_connectives", lx.CAUSAL_TERMS), terms("personal_osint", lx.PERSONAL_TERMS)])


SELECTS["txt_evidence"] = _evidence()
SELECTS["txt_documents"] = SELECTS["txt_structure"].replace("txt", "txt")

SELECTS["mail_features_wide"] = "SELECT * FROM wide"
SELECTS["onehot_auth"] = "SELECT mail_id, " + ", ".join(ONE_HOT) + " FROM one_hot"

_RANKED = "row_number() OVER (PARTITION BY label ORDER BY md5(CAST(mail_id AS VARCHAR) || '|42'))"
SELECTS["src_mail_csv"] = """SELECT mail_id AS id, label, template_id, category, subject, body_text, raw_email_source, notes
FROM mail"""
SELECTS["src_partial_headers"] = f"""
SELECT row_id AS id, label, CASE WHEN label = 1 THEN 'real_partial' ELSE 'real_partial_control' END AS template_id,
  CASE WHEN label = 1 THEN 'Real: partial phishing' ELSE 'Real: partial legitimate control' END AS category,
  coalesce(subject, '(no subject)') AS subject, body AS body_text,
  'From: ' || coalesce(sender, 'unknown@unknown.com') || chr(10)
  || 'To: ' || trim(string_split(coalesce(receiver, 'investor@example.com'), ',')[1]) || chr(10)
  || 'Subject: ' || coalesce(subject, '(no subject)') || chr(10)
  || 'Date: ' || coalesce(date, 'Tue, 01 Jan 2024 00:00:00 +0000') || chr(10)
  || 'Authentication-Results: mx.example.com; spf=none; dkim=none; dmarc=none' || chr(10) || chr(10)
  || body || chr(10) AS raw_email_source,
  'Real mail, partial headers only' AS notes
FROM partial WHERE length({strip('body')}) >= 10"""
SELECTS["src_capped_sample"] = f"""
SELECT id, label, body_text FROM (
  SELECT doc_id AS id, CAST(quality AS INT) AS label, text AS body_text
  FROM documents JOIN labels USING (doc_id)
  ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id LIMIT 250)
WHERE length({strip('body_text')}) >= 10"""
SELECTS["gen_mail"] = "SELECT * FROM generated"
_DOMAIN_OF = f"{sql_list([d for _, d in G.ENTITIES])}[c_custkey % {len(G.ENTITIES)} + 1]"
SELECTS["gen_spoof_domain"] = f"SELECT c_custkey, real, {_spoof('real', 'c_custkey')} AS spoofed FROM (SELECT c_custkey, {_DOMAIN_OF} AS real FROM customer)"
_STYLES = ["typosquat", "ip_address", "shortener", "email_embedded", "at_symbol", "clean"]
SELECTS["gen_fake_url"] = f"""
SELECT c_custkey, style, {_fake_url('c_custkey')} AS url FROM (
  SELECT *, {_spoof('real', 'c_custkey')} AS spoofed FROM (
    SELECT c_custkey, {_DOMAIN_OF} AS real, {sql_list(_STYLES)}[c_custkey % 6 + 1] AS style,
      lower(c_mktsegment) || '@example.com' AS victim_email FROM customer))"""
_LIMITS = " ".join(
    f"WHEN kind = {q(k)} THEN CASE WHEN ext NOT IN {in_list(e)} THEN 'unsupported_type' WHEN length > {cap} THEN 'too_large' END"
    for k, (e, cap) in lx.UPLOAD_LIMITS.items())
SELECTS["manifest_check"] = f"""
SELECT upload_id, ext AS extension, CASE {_LIMITS} ELSE 'unknown_kind' END AS reason,
  (CASE {_LIMITS} ELSE 'unknown_kind' END) IS NULL AS accepted
FROM (SELECT *, '.' || lower(list_last(string_split(path, '.'))) AS ext FROM upload)"""
SELECTS["flt_short_body"] = f"SELECT row_id, body FROM partial WHERE length({strip('body')}) >= 10"
SELECTS["mail_union"] = """SELECT 'mail' AS origin, mail_id AS id, label, subject FROM mail
UNION ALL SELECT 'partial', row_id, label, coalesce(subject, '(no subject)') FROM partial"""
SELECTS["label_counts"] = "SELECT label, template_id, category, count(*) AS n_rows FROM mail GROUP BY ALL"
SELECTS["class_balance"] = """
SELECT doc_id, lang FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42')) AS rn FROM documents)
WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM documents GROUP BY lang))"""
SELECTS["shuffle_renumber"] = """
SELECT doc_id, lang, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42'), doc_id) AS new_id FROM documents"""
SELECTS["stratified_split"] = """
SELECT doc_id, lang, rn <= CAST(floor(n * 0.2e0 + 0.5e0) AS BIGINT) AS is_test FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42')) AS rn,
    count(*) OVER (PARTITION BY lang) AS n FROM documents)"""
SELECTS["stratified_folds"] = """
SELECT doc_id, lang, CAST(CASE WHEN rn <= floor(n * 1 / 5e0) THEN 0 WHEN rn <= floor(n * 2 / 5e0) THEN 1
  WHEN rn <= floor(n * 3 / 5e0) THEN 2 WHEN rn <= floor(n * 4 / 5e0) THEN 3 ELSE 4 END AS INT) AS fold FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '|42')) AS rn,
    count(*) OVER (PARTITION BY lang) AS n FROM documents)"""

_TP = "count(*) FILTER (WHERE label = 1 AND prediction = 1)"
_FP = "count(*) FILTER (WHERE label = 0 AND prediction = 1)"
_FN = "count(*) FILTER (WHERE label = 1 AND prediction = 0)"
_TN = "count(*) FILTER (WHERE label = 0 AND prediction = 0)"
SELECTS["eval_metrics"] = f"""
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
  round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1
FROM (SELECT {_TP} AS tp, {_FP} AS fp, {_FN} AS fn, {_TN} AS tn FROM prediction)"""
SELECTS["eval_confusion"] = """SELECT label, count(*) FILTER (WHERE prediction = 0) AS predicted_0,
  count(*) FILTER (WHERE prediction = 1) AS predicted_1 FROM prediction GROUP BY label"""
SELECTS["eval_report"] = """
WITH per AS (
  SELECT CAST(c AS VARCHAR) AS class, count(*) FILTER (WHERE label = c AND prediction = c) AS tp,
    count(*) FILTER (WHERE label <> c AND prediction = c) AS fp, count(*) FILTER (WHERE label = c AND prediction <> c) AS fn
  FROM (@prediction@) AS p, (VALUES (0), (1)) AS v(c) GROUP BY c),
r AS (SELECT class, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, tp + fn AS support FROM per)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM r
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r""".replace("@prediction@", fixture_sql("prediction"))
SELECTS["tiering"] = "SELECT mail_id, " + ", ".join(
    f"{_tier('probability', top)} AS {channel}_tier" for channel, top in lx.TOP_TIER.items()
) + ", CASE WHEN probability >= 0.5 THEN 'phishing' ELSE 'legitimate' END AS decision FROM prediction"


def signal_weights(names: list[str]) -> dict[str, float]:
    """Declared stand-in importances for the checked query: the n-th feature in
    alphabetical order weighs n."""
    return {n: float(i + 1) for i, n in enumerate(sorted(names))}


_UNPIVOT = " UNION ALL ".join(
    f"SELECT mail_id, {q(n)} AS feature, CAST({n} AS DOUBLE) AS value, {w} AS weight FROM one_hot"
    for n, w in signal_weights(MODEL_NAMES).items())
SELECTS["top_signals"] = f"""
SELECT mail_id, CASE WHEN trust THEN 'trust' ELSE 'risk' END AS kind, CAST(rn - 1 AS INT) AS rank, feature, value FROM (
  SELECT *, row_number() OVER (PARTITION BY mail_id, trust ORDER BY weight DESC, feature) AS rn FROM (
    SELECT *, contains(feature, '_pass') AS trust FROM ({_UNPIVOT}) WHERE value > 0))
WHERE rn <= CASE WHEN trust THEN 5 ELSE 8 END"""


def _tree_sql(nodes: dict[int, tuple], k: int) -> str:
    _, _, _, feature, threshold, left, right, value = nodes[k]
    if feature is None:
        return f"{value}::DOUBLE"
    return f"CASE WHEN {feature} <= {threshold}::DOUBLE THEN {_tree_sql(nodes, left)} ELSE {_tree_sql(nodes, right)} END"


_TREES: dict[int, dict[int, tuple]] = {}
for _n in rule_nodes(MODEL_NAMES):
    _TREES.setdefault(_n[0], {})[_n[1]] = _n
_MARGIN = " + ".join(f"{t[0][2]}::DOUBLE * {_tree_sql(t, 0)}" for t in _TREES.values())
SELECTS["tree_scores"] = f"""
SELECT mail_id, label, {rounded('p', 4)} AS phishing_probability, {_tier('p', 'PHISHING')} AS risk_tier,
  CASE WHEN p >= 0.5 THEN 'phishing' ELSE 'legitimate' END AS prediction
FROM (SELECT mail_id, label, 1::DOUBLE / (1::DOUBLE + exp(-2::DOUBLE * ({_MARGIN}))) AS p FROM one_hot)"""
SELECTS["model_scores_agree"] = "SELECT mail_id, label, true AS same FROM mail"

SELECTS["beh_age"] = "SELECT post_id, account_age_days, very_new_account FROM behaviour"
SELECTS["beh_flags"] = """SELECT post_id, abnormal_posting_frequency, follower_following_ratio, suspicious_follow_ratio,
  suspicious_handle_pattern, suspicious_bio_keyword_count FROM behaviour"""
SELECTS["beh_redflags"] = "SELECT post_id, behavioral_red_flag_count, behavioral_red_flag_count >= 2 AS likely_coordinated_or_bot FROM behaviour"
SELECTS["soc_text_risk"] = f"SELECT post_id, {rounded('text_risk', 4)} AS text_risk_score FROM post_risk"
SELECTS["feature_align"] = ("SELECT mail_id, " + ", ".join(sorted(MODEL_NAMES)[::2])
                            + ", CAST(0 AS INT) AS header__arc_result_pass, CAST(0 AS INT) AS text__emoji_count FROM one_hot")
SELECTS["soc_fusion"] = SELECTS["stream_post_scan"] = f"""
SELECT post_id, {rounded('fused', 4)} AS fused_risk_score, {_tier('fused', 'MANIPULATIVE')} AS risk_tier, {rounded('text_risk', 4)} AS text_risk_score,
  CASE WHEN image_applicable IS NOT NULL THEN {rounded('image_risk', 4)} END AS image_risk_score, image_applicable,
  {rounded('account_risk', 4)} AS behavioral_risk_score FROM post_fused"""

SELECTS["ver_domain"] = f"""
SELECT c.claim_id, {strip('lower(c.domain)')} AS domain_checked, e.entity_id, e.entity_name, e.status, coalesce(e.status = 'active', false) AS verified
FROM claim AS c LEFT JOIN (SELECT d.domain, x.id AS entity_id, x.entity_name, x.status FROM entity_domain AS d JOIN entity AS x ON x.id = d.entity_id) AS e
  ON e.domain = {strip('lower(c.domain)')}"""
SELECTS["ver_handle"] = f"""
SELECT c.claim_id, {strip('lower(c.platform)')} AS platform_checked, {strip("ltrim(lower(c.handle), '@')")} AS handle_checked,
  e.entity_id, e.entity_name, e.status, coalesce(e.status = 'active', false) AS verified
FROM claim AS c LEFT JOIN (SELECT d.platform, d.handle, x.id AS entity_id, x.entity_name, x.status
    FROM entity_handle AS d JOIN entity AS x ON x.id = d.entity_id) AS e
  ON e.platform = {strip('lower(c.platform)')} AND e.handle = {strip("ltrim(lower(c.handle), '@')")}"""
SELECTS["ver_phone"] = f"""
SELECT c.claim_id, {strip('c.phone_number')} AS phone_number_checked, e.entity_id, e.entity_name, e.status, coalesce(e.status = 'active', false) AS verified
FROM claim AS c LEFT JOIN (SELECT d.phone_number, x.id AS entity_id, x.entity_name, x.status FROM entity_phone AS d JOIN entity AS x ON x.id = d.entity_id) AS e
  ON e.phone_number = {strip('c.phone_number')}"""
SELECTS["ver_executive"] = "SELECT claim_id, executive_authorized, executive_entity, executive_status FROM exec_claim"
_KNOWN = ", ".join(f"({q(d)}, {q(n)})" for d, n in lx.KNOWN_ENTITY_DOMAINS.items())
SELECTS["ver_sender"] = f"""
SELECT a.mail_id, a.addr AS from_addr, a.domain AS domain_checked, k.entity AS sender_entity, k.entity IS NOT NULL AS sender_verified
FROM addr AS a LEFT JOIN (VALUES {_KNOWN}) AS k(d, entity) ON k.d = a.domain WHERE a.kind = 'from'"""
SELECTS["ver_token"] = """
SELECT t.claim_id, t.token, e.entity_name, e.entity_type, e.status AS entity_status, c.content_hash, c.channel, c.subject,
  e.status = 'active' AS currently_valid, 'https://verify.example/v/' || t.token AS link
FROM token_claim AS t JOIN communication_hashed AS c ON c.verification_token = t.token JOIN entity AS e ON e.id = c.entity_id"""
# The notice under the signature of the entity's own key; nothing else is signed.
_SIGNED = f"(c.content = {q(NOTICE)} AND c.signature_b64 = CASE WHEN e.id % 2 = 1 THEN {q(SIGNATURES[0])} ELSE {q(SIGNATURES[1])} END)"
SELECTS["ver_signature"] = f"""
SELECT c.verification_token AS token, e.entity_name, CASE WHEN e.id IS NULL THEN 'unknown_entity' WHEN e.status <> 'active' THEN 'entity_revoked'
  WHEN {_SIGNED} THEN NULL ELSE 'signature_mismatch' END AS reason, coalesce(e.status = 'active' AND {_SIGNED}, false) AS verified
FROM (SELECT * REPLACE (CASE WHEN channel = 'sms' AND length(content) % 9 = 0 THEN entity_id + 1000000 ELSE entity_id END AS entity_id)
      FROM communication) AS c LEFT JOIN entity AS e ON e.id = c.entity_id"""
SELECTS["ver_token_content"] = f"""
SELECT t.claim_id, e.entity_name, CASE WHEN c.verification_token IS NULL THEN 'unknown_token' WHEN e.status <> 'active' THEN 'entity_revoked'
  WHEN sha256({strip('t.content')}) <> c.content_hash THEN 'content_tampered' WHEN {_SIGNED} THEN NULL ELSE 'signature_mismatch' END AS reason,
  c.verification_token IS NOT NULL AND e.status = 'active' AND sha256({strip('t.content')}) = c.content_hash AND {_SIGNED} AS verified
FROM token_claim AS t LEFT JOIN (SELECT h.* FROM communication_hashed AS h JOIN entity AS o ON o.id = h.entity_id) AS c ON c.verification_token = t.token
LEFT JOIN entity AS e ON e.id = c.entity_id"""
SELECTS["content_hash"] = f"SELECT doc_id, sha256({strip('text')}) AS content_hash FROM documents"
SELECTS["reg_enroll"] = f"""
SELECT domain, arg_min(entity_id, rank * 1000000000000 + seq) AS entity_id FROM (
  SELECT entity_id, domain, 0 AS rank, 0 AS seq FROM entity_domain
  UNION ALL SELECT o_custkey + 5000, {strip('lower(domain)')}, 1, o_orderkey FROM claim JOIN orders ON o_orderkey = claim_id)
GROUP BY domain"""
SELECTS["reg_enroll_phones"] = f"""
SELECT phone_number, arg_min(entity_id, rank * 1000000000000 + seq) AS entity_id FROM (
  SELECT entity_id, phone_number, 0 AS rank, 0 AS seq FROM entity_phone
  UNION ALL SELECT o_custkey + 5000, {strip('phone_number')}, 1, o_orderkey FROM claim JOIN orders ON o_orderkey = claim_id)
WHERE phone_number IS NOT NULL GROUP BY phone_number"""
SELECTS["reg_enroll_handles"] = f"""
SELECT platform, handle, arg_min(entity_id, rank * 1000000000000 + seq) AS entity_id FROM (
  SELECT entity_id, platform, handle, 0 AS rank, 0 AS seq FROM entity_handle
  UNION ALL SELECT o_custkey + 5000, {strip('lower(platform)')}, {strip("ltrim(lower(handle), '@')")}, 1, o_orderkey
  FROM claim JOIN orders ON o_orderkey = claim_id)
WHERE platform IS NOT NULL AND handle IS NOT NULL GROUP BY platform, handle"""
SELECTS["reg_enroll_executives"] = f"""
SELECT DISTINCT executive_name, entity_id FROM (
  SELECT entity_id, executive_name FROM entity_executive
  UNION ALL SELECT o_custkey + 5000, {strip('claimed_speaker_name')} FROM claim JOIN orders ON o_orderkey = claim_id)
WHERE executive_name IS NOT NULL"""
SELECTS["reg_enroll_entities"] = """
SELECT id, entity_name, entity_type, status FROM entity
UNION ALL SELECT (SELECT max(id) FROM entity) + c_custkey + 1, c_name, 'other', 'active' FROM customer"""
SELECTS["reg_revoke"] = """
SELECT e.id, e.entity_name, CASE WHEN r.k IS NOT NULL THEN 'revoked' ELSE e.status END AS status,
  r.k IS NOT NULL AND e.status = 'active' AS changed
FROM entity AS e LEFT JOIN (SELECT l_suppkey + 1 AS k FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (WHERE l_returnflag = 'R') * 4 > count(*)) AS r ON r.k = e.id"""
SELECTS["reg_seed"] = """
SELECT k.entity_name, (SELECT max(id) FROM entity) + k.request_no AS id,
  CASE WHEN k.entity_name <> 'Supplier#000000000' THEN CAST(1 AS BIGINT) END AS authorized_by_id
FROM (SELECT c_custkey + 1 AS request_no, c_name AS entity_name, 's' || (c_custkey * 3) || '.example.com' AS d1,
        'c' || c_custkey || '.example.org' AS d2 FROM customer) AS k
WHERE NOT EXISTS (SELECT 1 FROM entity_domain AS d WHERE d.domain IN (k.d1, k.d2))"""

SELECTS["med_frame_sample"] = "SELECT media_id, line_no, frame_index FROM frame WHERE frame_index % 15 = 0"
SELECTS["med_crop_box"] = """
SELECT media_id, line_no, frame_index, x, y, w, h, crop_x1, crop_y1, crop_x2, crop_y2 FROM (
  SELECT *, greatest(0, x - px) AS crop_x1, greatest(0, y - py) AS crop_y1,
    least(frame_width, x + w + px) AS crop_x2, least(frame_height, y + h + py) AS crop_y2
  FROM (SELECT *, CAST(trunc(w * 0.2e0) AS INT) AS px, CAST(trunc(h * 0.2e0) AS INT) AS py
    FROM (SELECT *, CAST(trunc(x1) AS INT) AS x, CAST(trunc(y1) AS INT) AS y, CAST(trunc(x2 - x1) AS INT) AS w,
      CAST(trunc(y2 - y1) AS INT) AS h FROM face_box)))
WHERE crop_x2 > crop_x1 AND crop_y2 > crop_y1"""
SELECTS["med_segments"] = """
SELECT media_id, CAST((s // 64000) AS INT) AS segment_no, s AS start_sample, least(s + 64000, total_samples) AS end_sample,
  least(s + 64000, total_samples) - s AS n_samples
FROM (SELECT media_id, total_samples, unnest(range(0, total_samples, 64000)) AS s FROM clip)"""
SELECTS["med_unit_score"] = """
SELECT unit_id, CASE WHEN p_second > p_first THEN second_label ELSE first_label END AS label, p_second AS fake_probability
FROM unit_probability"""
SELECTS["med_verdict"] = "SELECT 'video' AS channel, * FROM video_verdict UNION ALL SELECT 'audio', * FROM audio_verdict"
SELECTS["med_exec"] = """
SELECT v.media_id, v.risk_tier, c.claimed_speaker_name, c.executive_authorized, c.executive_status,
  coalesce(c.executive_authorized AND v.risk_tier IN ('DEEPFAKE', 'SYNTHETIC'), false) AS executive_impersonation
FROM video_verdict AS v LEFT JOIN exec_claim AS c ON c.claim_id = v.media_id"""
SELECTS["mail_verdict"] = f"""
SELECT p.mail_id, {rounded('p.probability', 4)} AS phishing_probability, {_tier('p.probability', 'PHISHING')} AS risk_tier,
  CASE WHEN p.probability >= 0.5 THEN 'phishing' ELSE 'legitimate' END AS prediction, a.domain AS domain_checked,
  k.entity AS sender_entity, k.entity IS NOT NULL AS sender_verified
FROM prediction AS p JOIN addr AS a ON a.mail_id = p.mail_id AND a.kind = 'from'
LEFT JOIN (VALUES {_KNOWN}) AS k(d, entity) ON k.d = a.domain"""
SELECTS["incident_report"] = f"""
SELECT coalesce(m.mail_id, v.media_id, s.user_id) AS incident_id, {_tier('m.probability', 'PHISHING').replace('CASE', 'CASE WHEN m.probability IS NULL THEN NULL')} AS mail_tier,
  m.probability AS mail_score, v.risk_tier AS video_tier, v.fake_probability AS video_score, s.tier AS social_tier, s.score AS social_score
FROM prediction AS m FULL JOIN (SELECT * FROM video_verdict) AS v ON v.media_id = m.mail_id
FULL JOIN (SELECT user_id, max(score) AS score, {_tier('max(fused)', 'MANIPULATIVE')} AS tier FROM (
    SELECT p.user_id, f.fused, {rounded('f.fused', 4)} AS score FROM post_fused AS f JOIN post AS p ON p.post_id = f.post_id) GROUP BY user_id) AS s
  ON s.user_id = coalesce(m.mail_id, v.media_id)"""


def _verdict_sql(channel: str, tier: str) -> str:
    top, red, yellow, green = VERDICT_TEXTS[channel]
    return f"CASE {tier} WHEN {q(top)} THEN {q(red)} WHEN 'SUSPICIOUS' THEN {q(yellow)} ELSE {q(green)} END"


_SIGNAL = "CASE " + " ".join(f"WHEN contains(f, {q(k)}) THEN {q(v)}" for k, v in SIGNAL_TEXTS.items()) + (
    " ELSE upper(w[1]) || w[2:] END")
SELECTS["verdict_text"] = f"""
SELECT p.mail_id, {_verdict_sql('mail', _tier('p.probability', 'PHISHING'))} AS mail_text,
  {_verdict_sql('video', _tier('p.probability', 'DEEPFAKE'))} AS video_text,
  {_verdict_sql('audio', _tier('p.probability', 'SYNTHETIC'))} AS audio_text,
  {_verdict_sql('social', _tier('p.probability', 'MANIPULATIVE'))} AS social_text, {_SIGNAL} AS signal_text
FROM (SELECT *, regexp_replace(replace(f, '_', ' '), '^(text|header|url)  ', '') AS w
      FROM (SELECT *, {sql_list(sorted(MODEL_NAMES))}[mail_id % {len(MODEL_NAMES)} + 1] AS f FROM prediction)) AS p"""
del SELECTS["txt_documents"]
SELECTS["mail_scan_facts"] = f"""
SELECT s.mail_id, s.sender_verified, s.sender_entity, s.domain_checked, true AS sound, e.category, e.matches
FROM ({SELECTS["ver_sender"]}) AS s, ({SELECTS["txt_evidence"]}) AS e WHERE e.mail_id = s.mail_id"""
SELECTS["model_facts"] = f"""
SELECT CAST({len(MODEL_NAMES)} AS BIGINT) AS n_features, true AS none_negative, 1.0::DOUBLE AS total
FROM (SELECT count(*) FROM documents)"""


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(sql) for name, sql in SELECTS.items()}
