"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP7 = rf"""
WITH t AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '{WORD}') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM t
), g AS (
  SELECT row_id, i, words[i:i+4] AS gram
  FROM (SELECT row_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), twice AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, gram) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT row_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT row_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY row_id
), m AS (
  SELECT w.row_id, doc_id, text, words, lines, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS stutters
  FROM w LEFT JOIN covered USING (row_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR 100 * n_symbols > 25 * n_words
            OR 100 * n_dup_lines > 40 * len(lines)
            OR 100 * length(regexp_replace(text, '[^!]', '', 'g')) > 50 * n_words
            OR 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 30 * word_chars
            OR 100 * stutters > 30 * n_words
            OR word_chars > 12 * n_words) AS kept
FROM b
"""


#: Unsigned CRC-32 of a text's bytes, bit by bit; DuckDB has no function for it.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))))"""

OP11 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER () AS row_id
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(role), ':', role, text)), row_id) AS place, role, text FROM t
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, max(place) AS n, {CRC32.format("conv_id::VARCHAR")} % 4 AS h FROM placed GROUP BY conv_id
), k AS (
  SELECT c.*, least(c.h, coalesce(b.n, 0)) AS k FROM c LEFT JOIN c AS b ON b.conv_id = c.base
), turns AS (
  SELECT k.conv_id, place - h + k AS depth, role, text FROM k JOIN placed USING (conv_id) WHERE place > h
  UNION ALL
  SELECT k.conv_id, place, role, text FROM k JOIN placed ON placed.conv_id = k.base AND place <= k
), prefix AS MATERIALIZED (
  SELECT conv_id, 0 AS depth, '' AS key, 0 AS words FROM k
  UNION ALL
  SELECT conv_id, depth, sha256(to_json(list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY depth))::VARCHAR),
         len(regexp_extract_all(text, '{WORD}'))
  FROM turns
), node AS MATERIALIZED (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM prefix GROUP BY ALL
), up AS MATERIALIZED (  -- each node with the one above it
  SELECT DISTINCT b.depth, b.key, a.key AS up FROM prefix a JOIN prefix b ON a.conv_id = b.conv_id AND b.depth = a.depth + 1
), kids AS (
  SELECT depth - 1 AS depth, up AS key, count(*) AS n FROM up GROUP BY ALL
), under AS (  -- each node with all of its subtree
  SELECT DISTINCT a.depth AS d, a.key AS top, b.depth, b.key FROM prefix a JOIN prefix b ON a.conv_id = b.conv_id AND b.depth >= a.depth
), whole AS (
  SELECT d AS depth, top AS key, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM under JOIN node USING (depth, key) LEFT JOIN kids USING (depth, key) GROUP BY ALL
), ends AS (
  SELECT max(depth) AS depth, arg_max(key, depth) AS key, conv_id FROM prefix GROUP BY conv_id
), ended AS (
  SELECT depth, key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM ends GROUP BY ALL
)
SELECT node.conv_id, node.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, whole.n_leaves,
       whole.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN whole USING (depth, key) LEFT JOIN kids USING (depth, key) LEFT JOIN ended USING (depth, key)
     LEFT JOIN up USING (depth, key) LEFT JOIN node AS above ON above.depth = node.depth - 1 AND above.key = up.up
"""


def merkle_leaf(text: str) -> str:
    """A row's digest, with an expression for its text."""
    parts = [f"coalesce(concat(strlen({v}), ':', {v}), '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256(concat({', '.join(parts)}))"


OP13 = f"""
WITH RECURSIVE doc AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS row_id, coalesce('=' || source, '-') AS grp, {merkle_leaf("text")} AS leaf,
         CASE WHEN ({CRC32.format("doc_id::VARCHAR")}) % 2 = 0 THEN {merkle_leaf("replace(text, chr(10), '')")} END AS other
  FROM documents
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, row_id) - 1 AS idx FROM doc
), low AS (
  SELECT 0 AS lvl, grp, idx, leaf AS h FROM placed
  UNION ALL
  SELECT lvl + 1, grp, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM low GROUP BY lvl, grp, idx // 3 HAVING NOT (idx // 3 = 0 AND count(*) = 1)
), sub AS MATERIALIZED (
  SELECT grp, arg_max(h, lvl) AS subroot, row_number() OVER (ORDER BY grp COLLATE 'binary') - 1 AS idx FROM low GROUP BY grp
), high AS (
  SELECT 0 AS lvl, idx, subroot AS h FROM sub
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM high GROUP BY lvl, idx // 3 HAVING NOT (idx // 3 = 0 AND count(*) = 1)
), steps AS MATERIALIZED (  -- of a node: what stands before and after it in its run, the upper tree's levels after the groups'
  SELECT a.grp, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM low a JOIN low b ON a.grp = b.grp AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 JOIN (SELECT grp, max(lvl) AS most FROM low GROUP BY grp) m ON m.grp = a.grp
  WHERE a.lvl < most GROUP BY ALL
  UNION ALL
  SELECT '', a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), ''), coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '')
  FROM high a JOIN high b ON a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.lvl < (SELECT max(lvl) FROM high) GROUP BY ALL
), path AS (  -- a row's way up: through its group's tree, over its subroot's place, through the upper tree
  SELECT row_id, grp, 0 AS lvl, idx, coalesce(other, leaf) AS h, '' AS proof FROM placed
  UNION ALL
  SELECT row_id, CASE WHEN s.grp IS NULL THEN '' ELSE path.grp END, CASE WHEN s.grp IS NULL THEN 0 ELSE path.lvl + 1 END,
         CASE WHEN s.grp IS NULL THEN sub.idx ELSE path.idx // 3 END,
         CASE WHEN s.grp IS NULL THEN path.h ELSE sha256(concat(s.before, path.h, s.after)) END,
         concat(path.proof, s.before, s.after)
  FROM path LEFT JOIN steps s ON s.grp = path.grp AND s.lvl = path.lvl AND s.idx = path.idx LEFT JOIN sub ON sub.grp = path.grp
  WHERE s.grp IS NOT NULL OR path.grp <> ''
), root AS (SELECT arg_max(h, lvl) AS root FROM high)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM placed JOIN sub USING (grp) CROSS JOIN root
     JOIN (SELECT row_id, h, proof FROM path WHERE grp = '' AND lvl = (SELECT max(lvl) FROM high)) USING (row_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": OP7, "op11_prefix_trie": OP11, "op13_merkle_manifest": OP13}
