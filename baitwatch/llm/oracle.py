"""DuckDB counterparts of the dealt operators that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP10 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS words FROM documents),
l AS (SELECT *, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 7], ' ')) AS h
      FROM (SELECT doc_id, words, unnest(range(1, n_words - 6)) AS i FROM l WHERE n_words > 8)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(8) AS s(k) GROUP BY doc_id),
m AS (SELECT l.*, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words FROM l LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 10 * n_symbols > word_chars THEN 4 ELSE 0 END)
        + (CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN word_chars > 30 * n_words THEN 16 ELSE 0 END)
        + (CASE WHEN 2 * word_chars < 3 * n_words THEN 32 ELSE 0 END) AS bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  bits & 3 <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS bits FROM b
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
        (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|23'), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE)
          / 4503599627370496::DOUBLE AS u FROM documents),
q AS (SELECT *, CASE WHEN size > 0 THEN u / (1::DOUBLE - u) / (size::DOUBLE / (size + 200)::DOUBLE) END AS q FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM q GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
a AS (SELECT *, coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 AS capped,
        sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w, sum(source_size) OVER () AS total
      FROM w WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)),
v AS (SELECT *, (total::DOUBLE * 1.5::DOUBLE - capped::DOUBLE) / left_w::DOUBLE AS level FROM a),
f AS (SELECT *, min({{'r': source_size / w, 'level': level}}) FILTER (level * w <= source_size * 2) OVER () AS found FROM v),
t AS (SELECT source, source_size, CASE WHEN found IS NULL THEN source_size * 2::DOUBLE
        ELSE least(source_size * 2::DOUBLE, found.level * w) END AS target FROM f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
k AS (SELECT source, q, sum(size) AS words FROM q WHERE q IS NOT NULL GROUP BY source, q),
r AS (SELECT k.*, target - whole * source_size AS rest,
        sum(words) OVER (PARTITION BY k.source ORDER BY q ROWS UNBOUNDED PRECEDING) AS upto
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
c AS (SELECT source, max(q) AS cut FROM r WHERE rest > 0 AND upto - rest <= rest - (upto - words) GROUP BY source)
SELECT doc_id, size, source_size, target,
  (whole + CASE WHEN q <= cut THEN 1 ELSE 0 END) * size AS taken,
  whole + CASE WHEN q <= cut THEN 1 ELSE 0 END AS copies
FROM q JOIN g ON q.source IS NOT DISTINCT FROM g.source LEFT JOIN c ON q.source IS NOT DISTINCT FROM c.source
"""

OP7 = r"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)),
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) AS s(i)),
d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size,
        xor(list_reduce(list_prepend(4294967295::BIGINT,
          list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
          lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32,
        md5(coalesce(doc_id::VARCHAR, '') || '|17') AS h FROM documents, tab),
f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, text_crc32) - 1 + 0.5::DOUBLE)
        / count(*) OVER (PARTITION BY source) AS f, count(*) OVER () AS n FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, h, doc_id, size, text_crc32) - 1 AS pos FROM f)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (pos * 24 // n)::INT AS shard,
  (pos - ((pos * 24 // n) * n + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard FROM p
"""

OP4 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
        sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f
"""

# Sets of shingles as text, pairs through common shingles, components by recursion.
OP5 = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id
      JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
      GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
c AS (SELECT a, a AS b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM c GROUP BY a) m USING (doc_id)
"""



def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Letters of the keywords in either case, ASCII only.
_ASSIGN = ("(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
           + """["\']?\\x20*[:=]\\x20*["\']?([A-Za-z0-9+/_.=-]+)""").replace("'", "''")


def _found(kind: int, pattern: str, group: int) -> str:
    """Matches with their places: text between matches and matches take turns."""
    return f"""SELECT doc_id, source, {kind} AS kind, unnest(regexp_extract_all(t, '{pattern}', {group})) AS v, unnest(regexp_extract_all(t, '{pattern}')) AS m,
      unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS k, string_split_regex(t, '{pattern}') AS s, regexp_extract_all(t, '{pattern}') AS ms FROM d"""


_PLACED = """SELECT doc_id, source, kind, v, b + coalesce(list_sum(list_transform(ms[:k - 1], lambda x: length(x))), 0) AS a, length(m) AS n
      FROM (SELECT *, coalesce(list_sum(list_transform(s[:k], lambda x: length(x))), 0) AS b FROM ({0}))"""
_HOLDERS = "(SELECT v, count(DISTINCT coalesce(source, '')) AS owners, count(DISTINCT (coalesce(source, ''), coalesce(doc_id::VARCHAR, ''))) AS repositories FROM c GROUP BY v)"

OP1 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
p AS MATERIALIZED ({" UNION ALL ".join(_PLACED.format(_found(k, x, g)) for k, x, g in (
    (0, _ASSIGN, 1), (1, "AKIA[A-Z0-9]{12,}", 0), (2, "[0-9a-f]{32,}", 0), (3, "[A-Za-z0-9+/_=-]{20,}", 0)))}),
b AS (SELECT * FROM p WHERE kind < 3 AND length(v) >= [8, 16, 32][kind + 1]),
r AS (SELECT * FROM p WHERE kind = 3 AND n >= 20 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
      AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = p.doc_id AND b.a < p.a + p.n AND p.a < b.a + b.n)),
c AS MATERIALIZED (SELECT * FROM b UNION ALL SELECT * FROM r),
e AS (SELECT v, -sum(f / length(v) * log2(f / length(v))) AS entropy FROM (
      SELECT v, x, count(*)::DOUBLE AS f FROM (SELECT v, unnest(string_split(v, '')) AS x FROM (SELECT DISTINCT v FROM c)) GROUP BY v, x) GROUP BY v),
j AS (SELECT c.*, owners >= 3 AS example, repositories, owners = 1 AND repositories < 100 AND entropy >= 3 AND NOT regexp_matches(lower(v),
        'example|sample|changeme|placeholder|dummy|redacted|xxxx|your|test|1234567|abcdefg') AS live
      FROM c JOIN {_HOLDERS} USING (v) JOIN e USING (v)),
w AS (SELECT *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || a || ':' || (a + n) AS span FROM j),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
        sha256(coalesce(string_agg(span, ',' ORDER BY a, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
        coalesce(string_agg(span, ',' ORDER BY a, kind) FILTER (WHERE kind < 3 OR live), '') AS spans,
        count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE example) AS n_example, max(repositories) AS n_repositories FROM w GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_repositories, 0) AS n_repositories
FROM d LEFT JOIN g USING (doc_id)
"""

# Turns in order; control strings get a backslash, frames are those of the marked template.
_CONTROL = r"([<\[])(\\*(?:/?s>|/?INST\]|OUT\]|/?SYS\]|/?ROLE\]))"
OP11 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' FROM range(2) AS s(i)),
e AS (SELECT *, length(regexp_replace(text, '{_CONTROL}', '\1\\\2', 'g')) + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 9
        ELSE 17 + length(regexp_replace(role, '{_CONTROL}', '\1\\\2', 'g')) END AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(n) + 3)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

# Every prefix of a rebuilt conversation as the joined digests of its turns.
OP12 = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
        md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, length(coalesce(text, '')) AS chars
      FROM conversations WHERE conv_id IS NOT NULL),
tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
        FROM range(256) AS s(i)),
h AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'),
        lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM t), tab),
r AS (SELECT h.conv_id, t.pos, t.id, t.chars FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100 AND t.pos < h.h
      UNION ALL SELECT t.conv_id, t.pos + 1000000, t.id, t.chars FROM t JOIN h USING (conv_id) WHERE t.pos >= h.h),
p AS (SELECT conv_id, chars, row_number() OVER w AS depth, string_agg(id, '') OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
m AS (SELECT conv_id, chars, depth, path FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM h),
g AS (SELECT conv_id, max(depth) AS last FROM m GROUP BY conv_id),
n AS (SELECT path, depth, max(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = last), '')) AS ends_sha256
      FROM m JOIN g USING (conv_id) GROUP BY path, depth),
k AS (SELECT substr(path, 1, length(path) - 32) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT substr(path, 1, 32 * d) AS path, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves
      FROM (SELECT *, unnest(range(depth + 1)) AS d FROM a) GROUP BY 1)
SELECT a.conv_id, a.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, a.n_convs::BIGINT AS n_convs, a.n_children::BIGINT AS n_children,
  u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, a.ends_sha256
FROM a JOIN u USING (path) LEFT JOIN a q ON a.depth > 0 AND q.path = substr(a.path, 1, length(a.path) - 32)
"""

_TERMS = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
OP13 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS doc, {_TERMS} AS terms FROM documents),
n AS (SELECT doc_id, doc, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n),
f AS (SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(terms) AS term FROM d) GROUP BY doc, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY term, docs),
i AS (SELECT DISTINCT item_id, text, term FROM (SELECT item_id, text, unnest({_TERMS}) AS term FROM benchmark)),
s AS (SELECT item_id, text, doc_id, doc, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
      FROM i JOIN w USING (term) JOIN f USING (term) JOIN n USING (doc), c GROUP BY item_id, text, doc_id, doc),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 50
"""

ORACLE_SQL = {"op1_secret_scan": OP1, "op4_warc": OP4, "op5_ngram_join": OP5,
              "op7_sharding": OP7, "op8_mixing": OP8, "op10_quality_rules": OP10,
              "op11_chat_format": OP11, "op12_prefix_trie": OP12, "op13_lexical_search": OP13}
