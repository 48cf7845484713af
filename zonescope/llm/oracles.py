"""Expected results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from zonescope.llm import quality
from zonescope.llm.text import WORD

MIXING = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 2.0 * source_size AS cap,
    [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM s),
steps AS (
  SELECT *, row_number() OVER o AS step,
    (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING
      AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      AS level
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
t AS (
  SELECT source, source_size,
    least(cap, coalesce(w * (SELECT arg_min(level, step) FROM steps WHERE level * w <= cap), cap))
      ::DOUBLE AS target
  FROM steps),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END
    AS epochs FROM t),
p AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs,
    CAST(floor(b.target) AS BIGINT) - b.epochs * b.source_size AS rest,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k) AS BIGINT) AS upto,
    CAST(sum(size) OVER (PARTITION BY d.source, k) AS BIGINT) AS block
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * epochs + CASE WHEN upto <= rest THEN size
    WHEN upto - block < rest THEN size * (rest - upto + block) // block ELSE 0 END AS BIGINT)
    AS taken
FROM p
"""

_VALUES = "\n    UNION ALL ".join(
    f"SELECT doc_id, lang, source, '{f.measure}' AS measure, "
    f"CAST({v} AS DOUBLE) AS v FROM base WHERE NOT base_failed"
    for f, v in zip(quality.FENCES, (
        "n_symbols / n_words", "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END",
        "n_repeat_words / n_words", "word_chars / n_words"), strict=True))
_FENCES = ", ".join(f"('{f.measure}', {f.spread}, {f.slack})" for f in quality.FENCES)


def _quantiles(by: str) -> str:
    group, on = (f"{by}, " if by else ""), f"PARTITION BY {by + ', ' if by else ''}measure"
    at = (f"min(CASE WHEN upto >= docs * {{}} THEN CASE WHEN bucket = {quality.ZERO} THEN 0.0 ELSE "
          f"pow({quality.BASE!r}, bucket) * {2.0 / (quality.BASE + 1)!r} END END)")
    return f"""(
    SELECT {group}measure, max(docs) AS docs, {at.format(quality.LOW)} AS low,
      {at.format(quality.MIDDLE)} AS middle
    FROM (SELECT *, sum(n) OVER ({on} ORDER BY bucket) AS upto, sum(n) OVER ({on}) AS docs
      FROM (SELECT {group}measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL))
    GROUP BY {group}measure)"""


def _pick(name: str) -> str:
    least = quality.MIN_DOCS
    return (f"CASE WHEN f.docs >= {least} THEN f.{name} WHEN l.docs >= {least} THEN l.{name} "
            f"ELSE a.{name} END")


QUALITY = f"""
WITH words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM documents),
tri AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) > 2)),
again AS (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS i
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM again GROUP BY doc_id),
base AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words
      > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM (
    SELECT doc_id, lang, source, len(w) AS n_words, len(lines) AS n_lines,
      length(array_to_string(w, '')) AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines,
      coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM words LEFT JOIN rep USING (doc_id))),
v AS ({_VALUES}),
sketch AS (
  SELECT lang, source, measure, CASE WHEN v < {quality.LEAST!r} THEN {quality.ZERO}
    ELSE CAST(ceil(ln(v) / ln({quality.BASE!r})) AS INT) END AS bucket, count(*) AS n
  FROM v GROUP BY ALL),
fences AS (
  SELECT f.lang, f.source, f.measure,
    {_pick("middle")} + spread * ({_pick("middle")} - ({_pick("low")})) + slack AS fence
  FROM {_quantiles("lang, source")} f JOIN {_quantiles("lang")} l
    ON l.lang IS NOT DISTINCT FROM f.lang AND l.measure = f.measure
  JOIN {_quantiles("")} a ON a.measure = f.measure
  JOIN (VALUES {_FENCES}) c(m, spread, slack) ON m = f.measure),
failed AS (
  SELECT DISTINCT v.doc_id FROM v JOIN fences f ON v.lang IS NOT DISTINCT FROM f.lang
    AND v.source IS NOT DISTINCT FROM f.source AND v.measure = f.measure WHERE v.v > fence)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_lines AS BIGINT) AS n_lines,
  CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM failed) AS kept
FROM base
"""

URLS = """
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(v, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (
  SELECT page_id, arg_max(h || p, len(h) * 100 + len(p)) AS rule,
    arg_max(v, len(h) * 100 + len(p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (page_id)
"""

REVISITS = """
WITH v AS (SELECT *, unnest([0, 1, 2, 3]) AS visit FROM pages),
c AS (
  SELECT page_id || '-' || visit AS record_id, page_id, visit,
    1700000000 + page_id * 10 + visit * 86400 AS ts,
    visit = 0 OR visit = 2 AND page_id % 4 = 0 AS is_full,
    lower(regexp_extract(url, '^([^/]*://[^/?#]*)', 1))
      || CASE WHEN regexp_extract(url, '^[^/]*://[^/?#]*([^?#]*)', 1) = '' THEN '/'
        ELSE regexp_extract(url, '^[^/]*://[^/?#]*([^?#]*)', 1) END
      || regexp_extract(url, '^[^?#]*([?][^#]+)', 1) AS canonical_url,
    CASE WHEN visit = 2 AND page_id % 4 = 0 THEN md5(html || '2') WHEN visit IN (0, 1) THEN md5(html)
      WHEN visit = 3 AND page_id % 7 <> 0 THEN md5(html) END AS etag,
    CASE WHEN visit = 0 OR visit = 2 AND page_id % 4 <> 0 THEN 't' || page_id END AS modified,
    CASE visit WHEN 0 THEN 'd0' WHEN 1 THEN 'd1' WHEN 3 THEN 'd3'
      ELSE CASE WHEN page_id % 4 = 0 THEN 'd2' END END AS date,
    CASE WHEN visit = 2 AND page_id % 4 <> 0 THEN 'c2' END AS cache,
    CASE WHEN visit = 0 THEN length(html) WHEN visit = 1 THEN 0
      WHEN visit = 2 AND page_id % 4 = 0 THEN length(html) + 1 END AS size
  FROM v),
f AS (
  SELECT canonical_url, ts, arg_max(c, record_id) AS r FROM c WHERE is_full GROUP BY ALL),
j AS (
  SELECT c.*, f.r, coalesce(f.r.etag = c.etag, f.r.modified = c.modified) AS agree
  FROM c ASOF LEFT JOIN f ON c.canonical_url = f.canonical_url AND c.ts > f.ts),
m AS (
  SELECT *, CASE WHEN is_full THEN 'full' WHEN r IS NULL THEN 'orphan' WHEN agree THEN 'resolved'
    WHEN NOT agree THEN 'mismatch' ELSE 'unchecked' END AS resolution FROM j),
h AS (
  SELECT *, resolution = 'resolved' AS good, CASE WHEN visit = 1 THEN 'W/' || etag ELSE etag END
    AS own_etag FROM m)
SELECT record_id, canonical_url, resolution, CASE WHEN good THEN r.record_id END AS refers_to,
  array_to_string(list_filter([
    'cache-control=' || CASE WHEN good THEN coalesce(cache, r.cache) ELSE cache END,
    'content-length=' || CASE WHEN good THEN r.size ELSE size END,
    'date=' || CASE WHEN good THEN coalesce(date, r.date) ELSE date END,
    'etag=' || CASE WHEN good THEN coalesce(own_etag, r.etag) ELSE own_etag END,
    'last-modified=' || CASE WHEN good THEN coalesce(modified, r.modified) ELSE modified END
  ], lambda x: x IS NOT NULL), ';') AS merged_headers
FROM h
"""

#: The unsigned CRC-32 of a number's digits (3988292384 is the reversed polynomial).
TRIE = """
WITH crc AS MATERIALIZED (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS step
  FROM (SELECT unnest(range(256)) AS i)),
t AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(encode(coalesce(role, '')) || '\\x00'::BLOB || encode(coalesce(text, '')))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
    [4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
      lambda d: ascii(d)::BIGINT),
    lambda s, b: xor(s // 256, step[xor(s % 256, b) + 1]))) % 6 AS h
  FROM t, crc),
r AS (
  SELECT c.conv_id, 0 AS own, place, said FROM c JOIN t ON t.conv_id = base AND place <= h
  UNION ALL
  SELECT conv_id, 1, place, said FROM c JOIN t USING (conv_id) WHERE place > h),
p AS (
  SELECT conv_id, row_number() OVER o AS depth, list(said) OVER o AS path,
    lead(place) OVER o IS NULL AS ends
  FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY own, place ROWS UNBOUNDED PRECEDING)
  UNION ALL
  SELECT conv_id, 0, [], conv_id NOT IN (SELECT conv_id FROM r) FROM c),
n AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
      FILTER (WHERE ends), '')) AS ends_sha256
  FROM p GROUP BY depth, path),
k AS (
  SELECT n.*, up.conv_id AS parent_conv_id, (SELECT count(*) FROM n AS down
    WHERE down.depth = n.depth + 1 AND down.path[1:n.depth] = n.path) AS n_children
  FROM n LEFT JOIN n AS up ON up.depth = n.depth - 1 AND up.path = n.path[1:n.depth - 1]),
b AS (
  SELECT top.depth, top.path, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves,
    sum((k.n_convs - 1) * coalesce(length(k.path[-1].text), 0))::BIGINT AS saved_tokens
  FROM k AS top JOIN k ON k.depth >= top.depth AND k.path[1:top.depth] = top.path
  GROUP BY top.depth, top.path)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM k JOIN b USING (depth, path)
"""

NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: (x IS NULL) OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id,
  positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY rank <= 5
"""

ORACLES = {
    "op2_source_mixing": MIXING,
    "op4_quality_rules": QUALITY,
    "op6_revisit_resolution": REVISITS,
    "op10_url_filters": URLS,
    "op11_hard_negatives": NEGATIVES,
    "op13_prefix_trie": TRIE,
}
