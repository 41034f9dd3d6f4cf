"""DuckDB SQL for corpus queries whose answer SQL can express, over whole tables."""

from __future__ import annotations

from quadrille.llm import quality

BLANKS = r"[\x20\x09-\x0D]+"


def words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{BLANKS}'), lambda w: w <> '')"


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {words(LOWER)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM w UNION SELECT b, root FROM reach JOIN both_ways ON a = node),
roots AS (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM roots LEFT JOIN sizes USING (doc_id)
"""

WINDOWS = f"""
WITH w AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM w),
starts AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
later AS (SELECT doc_id, i AS pos FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS first FROM starts) WHERE doc_id > first),
near AS (
  SELECT e.doc_id, e.pos, word, coalesce(e.pos - max(l.pos) OVER (PARTITION BY e.doc_id ORDER BY e.pos) < 50, false) AS gone
  FROM each e LEFT JOIN later l ON l.doc_id = e.doc_id AND l.pos = e.pos),
kept AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS body
  FROM near GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

BYTES = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
cut AS (SELECT doc_id, k * 256 AS base, substr(h, k * 512 + 1, 710) AS h, length(h) // 2 - k * 256 AS left_over FROM (SELECT *, unnest(range(0, length(h) // 512 + 1)) AS k FROM h)),
each AS (SELECT doc_id, base, h, unnest(range(0, least(256, left_over))) AS i FROM cut),
bytes AS (SELECT doc_id, base + i AS pos, substr(h, 2 * i + 1, 2) AS byte, substr(h, 2 * i + 1, 200) AS s FROM each),
starts AS (SELECT doc_id, pos, s FROM bytes WHERE length(s) = 200),
later AS (
  SELECT doc_id, pos FROM (SELECT *, min(doc_id::HUGEINT * 4294967296 + pos) OVER (PARTITION BY s) AS first FROM starts)
  WHERE doc_id::HUGEINT * 4294967296 + pos > first),
near AS (
  SELECT e.doc_id, e.pos, byte, coalesce(e.pos - max(l.pos) OVER (PARTITION BY e.doc_id ORDER BY e.pos) < 100, false) AS gone
  FROM bytes e LEFT JOIN later l ON l.doc_id = e.doc_id AND l.pos = e.pos),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM near),
kept AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, count(*) FILTER (opens) AS spans, string_agg(byte, '' ORDER BY pos) FILTER (NOT gone) AS body
  FROM edges GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(body, ''))) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id)
"""

_PHRASES = " OR ".join("contains(lower(line), '{}')".format(p.replace("'", "''")) for p in quality.PHRASES)

QUALITY = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {words("coalesce(text, '')")} AS w FROM documents),
lines AS (SELECT doc_id, unnest(range(0, len(l))) AS place, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM t)),
said AS (SELECT *, len(w) AS n FROM (SELECT *, {words("line")} AS w FROM lines) WHERE len(w) > 0),
judged AS (
  SELECT *, (n < 10 AND NOT regexp_matches(line, '(?s)^.*[.!?…。！？:;]["''”’»)\\]*\\x09-\\x0D\\x20]*$'))
    OR len(list_filter(w, lambda x: regexp_full_match(x, '[|»›>•·/]+'))) * 4 > n
    OR len(regexp_extract_all(line, '[#*$%&|<>]')) * 3 > n
    OR (n >= 8 AND len(list_distinct(w)) * 4 < n)
    OR (n >= 3 AND upper(line) = line AND lower(line) <> line)
    OR {_PHRASES} AS fails
  FROM said),
by_doc AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dups, coalesce(sum(n) FILTER (fails), 0) AS lost, string_agg(line, chr(10) ORDER BY place) FILTER (NOT fails) AS clean
  FROM judged GROUP BY doc_id),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM grams) WHERE k > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, range(0, 3) AS r(d) GROUP BY doc_id),
figures AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_lost_words, sha256(coalesce(clean, '')) AS clean_sha256
  FROM t LEFT JOIN by_doc b ON b.doc_id = t.doc_id LEFT JOIN repeats r ON r.doc_id = t.doc_id),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT *, NOT base_failed AND 100 * n_lost_words <= 50 * n_words AS kept FROM based
"""
