"""DuckDB SQL of the operators' queries, where SQL can express them.

Operators 2, 3, 5 and 6 (components, template tree, merges, hypervectors) are beyond it; tests hold those
against brute force, the tokenizer's own library and held-out accuracy.
"""

from __future__ import annotations

from lodestone.llm.quality import POLICIES, PRODUCTION
from lodestone.llm.quality import RULES as QUALITY_RULES

_WORD = r"[^\x20\x09-\x0D]+"

TOKEN_COUNTS = rf"""
WITH c AS (SELECT doc_id, source, lang, coalesce(text, '') AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]*[0-9A-Za-z\x{{80}}-\x{{10FFFF}}][^\x20\x09-\x0D]*')) AS b,
    len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+')) AS c FROM documents),
f AS (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY t) AS copy FROM c),
v AS (SELECT source, lang, 'words-1' AS tokenizer, b AS n FROM f WHERE NOT copy UNION ALL SELECT source, lang, 'runs-2', c FROM f WHERE NOT copy)
SELECT source, lang, tokenizer, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM v GROUP BY ALL HAVING count(*) <> 0 OR sum(n) <> 0
"""

_rejected = " OR ".join(f"({r.fails})" for r in QUALITY_RULES if r.name in PRODUCTION.rules)
_bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in QUALITY_RULES)

_MEASURES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
h AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM h),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines_with_words FROM w LEFT JOIN p USING (doc_id))
"""

QUALITY = rf"""{_MEASURES}SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT ({_rejected}) AS kept, ({_bits})::BIGINT AS fail_bits FROM m
"""

_failed = {r.name: f"({r.fails})" for r in QUALITY_RULES}
_cases = "\nUNION ALL ".join(
    f"SELECT '{p.version}' AS policy, '{name}' AS rule, count(*) FILTER ({_failed[name]}) AS failed, count(*) FILTER ({' AND '.join(_failed[o] if o == name else f'NOT {_failed[o]}' for o in p.rules)}) AS failed_alone, count(*) FILTER ({' OR '.join(_failed[o] for o in p.rules)}) AS rejected FROM m"
    for p in POLICIES
    for name in p.rules
)
ABLATIONS = f"{_MEASURES}{_cases}"

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: SHA-1 hex as base32: four bits a digit, read again five at a time.
_BASE32 = f"array_to_string(list_transform(range(0, 32), lambda g: '{_ALPHABET}'[1 + list_sum(list_transform(range(0, 5), lambda k: (((position(s[1 + (g * 5 + k) // 4] IN '0123456789abcdef') - 1) >> (3 - (g * 5 + k) % 4)) & 1) << (4 - k)))::INT]), '')"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, strlen(h) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p
"""

_ESC = r"regexp_replace({x}, '<(\\*)\|', '<\\\1|', 'g')"

CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, 23 + length({_ESC.format(x="role")}) + length({_ESC.format(x="text")}) AS chars, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER w AS replies FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS so_far FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(CASE WHEN role = 'assistant' OR n = total THEN so_far ELSE 0 END)::BIGINT AS formatted_chars FROM s GROUP BY conv_id
"""

#: The notices of the tables, as patterns of their own, and what each says.
_NOTICES = {
    r"released under the mit license": "MIT",
    r"licensed under the apache license, version 2\.0": "Apache-2.0",
    r"this work is licensed under the gnu general public license, version 3": "GPL-3.0-only",
    r"licensed under cc by-nc 4\.0": "CC-BY-NC-4.0",
}
_seen = ", ".join(f"CASE WHEN n{i} > 0 THEN '{name}' END" for i, name in enumerate(_NOTICES.values()))

LICENCES = rf"""
WITH c AS (SELECT doc_id, {", ".join(f"len(regexp_extract_all(coalesce(lower(text), ''), '{p}[.]'))::BIGINT AS n{i}" for i, p in enumerate(_NOTICES))},
    len(regexp_extract_all(coalesce(lower(text), ''), 'all rights reserved[.]'))::BIGINT AS reserved FROM documents),
f AS (SELECT *, list_sort(list_filter([{_seen}, CASE WHEN reserved > 0 THEN 'Proprietary' END], lambda x: x IS NOT NULL)) AS got FROM c)
SELECT doc_id, {" + ".join(f"n{i}" for i in range(len(_NOTICES)))} + reserved AS n_sentences, coalesce(array_to_string(got, ','), '') AS licences,
    CASE WHEN len(got) = 0 THEN 'none' WHEN len(got) = 1 THEN 'single' ELSE 'multiple' END AS status FROM f
"""

_ITEM_WORDS = r"list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"

DECONTAMINATION = f"""
WITH i AS (SELECT item_id::VARCHAR AS item_id, {_ITEM_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[n:n + least(10, len(w)) - 1], ' ') AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS n FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
g AS (SELECT doc_id, n, k, array_to_string(w[n:n + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS n FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k)),
h AS (SELECT g.doc_id, g.n, g.k, v.item_id FROM g JOIN v USING (k, x)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(n, n + k)) AS p FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""

#: Unsigned CRC-32 of the bytes of x (reflected polynomial 0xEDB88320): eight shifts a byte.
_SHIFT = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, {x})"
_BYTES = "list_transform(range(1, 1 + strlen({x})), lambda i: (position(substr(hex(encode({x})), 2 * i - 1, 1) IN '0123456789ABCDEF') - 1) * 16 + position(substr(hex(encode({x})), 2 * i, 1) IN '0123456789ABCDEF') - 1)"


def _crc32(x: str) -> str:
    return f"xor(list_reduce({_BYTES.format(x=x)}, lambda c, b: {_SHIFT.format(x='xor(c, b::BIGINT)')}, 4294967295::BIGINT), 4294967295)"


RESAMPLING = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT unnest({_ITEM_WORDS}) AS x FROM benchmark),
e AS (SELECT doc_id, unnest(w) AS x FROM d),
v AS (SELECT x, ({_crc32("x")} % 10000)::INT AS k FROM (SELECT x FROM e UNION SELECT x FROM b)),
s AS (SELECT k, count(*) AS s FROM e JOIN v USING (x) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM b JOIN v USING (x) GROUP BY k),
a AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS n_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS n_t),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (n_s + 10000.0::DOUBLE) / ((s::DOUBLE + 1) * (n_t + 10000.0::DOUBLE))))::BIGINT AS gain FROM s LEFT JOIN t USING (k), a),
m AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM e JOIN v USING (x) JOIN g USING (k) GROUP BY doc_id),
h AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (doc_id)),
c AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM c WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM c LEFT JOIN r USING (doc_id)
"""

TRIE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
i AS (SELECT c, c::VARCHAR AS x FROM (SELECT DISTINCT conv_id AS c FROM conversations)),
h AS (SELECT c, c - c % 5 AS base, {_crc32("x")} % 9 AS h FROM i),
r AS (SELECT c, n, role, text FROM h JOIN t ON t.conv_id = base AND n <= h UNION ALL SELECT c, n, role, text FROM h JOIN t ON t.conv_id = c AND n > h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY n) AS d, sha256(strlen(role) || ':' || role || text) AS k, strlen(text) AS bytes FROM r),
p AS (SELECT c, d, string_agg(k, ',') OVER (PARTITION BY c ORDER BY d) AS x, bytes FROM q UNION ALL SELECT c, 0, '', 0 FROM h),
m AS (SELECT c, d, bytes, min(c) OVER (PARTITION BY d, x) AS node, count(*) OVER (PARTITION BY d, x) AS n, max(d) OVER (PARTITION BY c) AS len FROM p),
v AS (SELECT node, d, any_value(n) AS n, any_value(bytes) AS bytes, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len) AS ends FROM m GROUP BY node, d),
u AS (SELECT v.node, v.d, v.n, v.bytes, v.ends, m.node AS parent FROM v LEFT JOIN m ON m.c = v.node AND m.d = v.d - 1),
k AS (SELECT parent AS node, d - 1 AS d, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL),
w AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (node, d)),
s AS (SELECT m.node, m.d, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n - 1) * w.bytes)::BIGINT AS saved FROM w JOIN m ON m.c = w.node AND m.d <= w.d GROUP BY ALL)
SELECT node AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, n_children, n_leaves, saved AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM w JOIN s USING (node, d)
"""

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES: dict[str, str] = {
    "op1_token_counts": TOKEN_COUNTS,
    "op4_quality_rules": QUALITY,
    "quality_ablations": ABLATIONS,
    "op7_warc": WARC,
    "op8_chat": CHAT,
    "op9_license_scan": LICENCES,
    "op10_decontamination": DECONTAMINATION,
    "op11_prefix_trie": TRIE,
    "op12_exact_topk": TOPK,
    "op13_importance_resampling": RESAMPLING,
}
