"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from claimspark.llm.chat_format import BEGIN, CONTROL, ESCAPES, MARKS, OTHER_CLOSE, OTHER_MID, OTHER_OPEN


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _chat_sql() -> str:
    escaped = "{0}"
    for plain, coded in ESCAPES:
        escaped = f"replace({escaped}, {_quote(plain)}, {_quote(coded)})"
    hostile = " OR ".join(f"contains(text, {_quote(m)})" for m in (*CONTROL, *[c for _, c in ESCAPES]))
    frame = "CASE role " + " ".join(f"WHEN {_quote(r)} THEN {len(a) + len(b)}" for r, (a, b) in MARKS.items())
    frame += f" ELSE {len(OTHER_OPEN + OTHER_MID + OTHER_CLOSE)} + length({escaped.format('role')}) END"
    return f"""
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (SELECT *, CASE WHEN {hostile} THEN {escaped.format('text')} ELSE text END AS shown FROM src),
folded AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    {len(BEGIN)} + sum({frame} + length(shown)) AS formatted_chars
  FROM shown GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM folded"""


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

WARC_SQL = f"""
WITH src AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
first AS (SELECT html, min(page_id) AS first_id FROM src GROUP BY html)
SELECT src.page_id, strlen(src.html) AS payload_bytes,
  list_aggregate([substr('{_BASE32}', CAST(
      (CAST('0x' || substr(hex, 1 + 10 * (k // 8), 10) AS BIGINT) >> (35 - 5 * (k % 8))) & 31 AS INTEGER) + 1, 1)
    for k in range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN src.page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN src.page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM src JOIN first USING (html)"""

_STEPS = "".join(f"crc{k} AS (SELECT byte, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END AS crc FROM crc{k - 1}),\n"
                 for k in range(1, 9))  # the byte table of CRC-32, bit by bit

TRIE_SQL = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
crc0 AS (SELECT i AS byte, i AS crc FROM range(256) AS r(i)),
{_STEPS}crcs AS (SELECT list(crc ORDER BY byte) AS t FROM crc8),
ids AS (
  SELECT c AS conv_id, c - c % 100 AS base,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM turns), crcs),
rebuilt AS (
  SELECT i.conv_id, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.base AND t.pos < i.h
  UNION ALL SELECT i.conv_id, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.pos >= i.h),
named AS (
  SELECT conv_id, row_number() OVER w AS depth, text, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER w AS prefix
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
members AS (
  SELECT conv_id, depth, prefix, length(text) AS chars FROM named
  UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
sizes AS (SELECT conv_id, max(depth) AS size FROM members GROUP BY 1),
nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM members JOIN sizes USING (conv_id) GROUP BY 1, 2),
up AS (  -- a node's members pass through its ancestors
  SELECT n.depth, n.prefix, p.prefix AS above, p.depth AS above_depth
  FROM nodes n JOIN members p ON p.conv_id = n.conv_id AND p.depth <= n.depth),
kids AS (SELECT above_depth AS depth, above AS prefix, count(*) AS n_children FROM up WHERE above_depth = depth - 1 GROUP BY 1, 2),
sums AS (
  SELECT up.above_depth AS depth, up.above AS prefix, count(*) FILTER (k.n_children IS NULL) AS n_leaves,
    sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM up JOIN nodes n ON n.depth = up.depth AND n.prefix = up.prefix
  LEFT JOIN kids k ON k.depth = up.depth AND k.prefix = up.prefix GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
  s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.prefix = n.prefix
LEFT JOIN kids k ON k.depth = n.depth AND k.prefix = n.prefix
LEFT JOIN up u ON u.depth = n.depth AND u.prefix = n.prefix AND u.above_depth = n.depth - 1
LEFT JOIN nodes p ON p.depth = u.above_depth AND p.prefix = u.above"""

AUDIT_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
uses AS (SELECT d, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM uses GROUP BY 1, 2 HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY 1),
counts AS (SELECT u.lang, u.source, u.term, CAST(count(*) AS HUGEINT) AS n
           FROM uses u JOIN kept k ON k.lang = u.lang AND k.term = u.term GROUP BY 1, 2, 3),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY 1, 2),
groups AS (SELECT g.lang, g.source, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g
           LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.v) AS p, 1 + 1000000000 * (k.n + 2) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item,
    coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM shares x JOIN shares y ON y.lang = x.lang AND y.term = x.term
              WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
WHERE part = 'pair' OR rank <= 10"""

ANCHOR_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS spot FROM docs WHERE len(w) >= 13 AND doc_id IS NOT NULL),
wins AS (SELECT r, doc_id, spot, sha256(array_to_string(w[spot:spot + 12], ' ')) AS win FROM places),
owners AS (SELECT win, min(doc_id) AS owner FROM wins GROUP BY 1),
gone AS (SELECT DISTINCT r, unnest(range(spot, spot + 13)) AS spot FROM wins JOIN owners USING (win) WHERE owner < doc_id),
lists AS (SELECT r, list(spot) AS gone FROM gone GROUP BY 1),
spots AS (SELECT r, unnest(range(1, len(w) + 1)) AS spot, unnest(w) AS word FROM docs),
kept AS (SELECT s.r, string_agg(s.word, ' ' ORDER BY s.spot) AS text FROM spots s LEFT JOIN gone g ON g.r = s.r AND g.spot = s.spot
         WHERE g.spot IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(l.gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN lists l ON l.r = d.r LEFT JOIN kept k ON k.r = d.r"""


SQL = {
    "op8_chat_format": _chat_sql(),
    "op10_warc": WARC_SQL,
    "op11_prefix_trie": TRIE_SQL,
    "op12_divergence_audit": AUDIT_SQL,
    "op13_anchor_dedup": ANCHOR_SQL,
}
