"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {
    "op2_url_filters": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), listed AS (
  SELECT unnest(['ads-track.example.org', 'casino-win.example.org', 'cheap-pills.example.com', 'free-bets.example.com', 'spam-farm.example.org']) AS key
  UNION SELECT host FROM parts WHERE host <> '' AND starts_with(md5(host), '0')
), above AS (
  SELECT DISTINCT host, array_to_string(labels[i:], '.') AS key
  FROM (SELECT host, string_split(host, '.') AS labels, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM (SELECT DISTINCT host FROM parts))
), below AS (
  SELECT host FROM above WHERE key IN (SELECT key FROM listed)
), named AS (
  SELECT page_id, host, path,
    CASE
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7'
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/'
    END AS rule,
    host IN (SELECT host FROM below) AS listed
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
  listed
FROM named
""",
    "op10_exact_top_k": r"""
WITH whole AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces WHERE regexp_matches(piece, '[^\x20\x09]')
), f1 AS (
  SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM lists) GROUP BY ALL
), f2 AS (
  SELECT lang, p.a AS x, p.b AS y, count(*) AS f FROM (SELECT lang, unnest([{'a': w[i], 'b': w[i + 1]} FOR i IN range(1, len(w))]) AS p FROM lists) GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
  SELECT lang, p.a AS x, p.b AS y, p.c AS z, count(*) AS f FROM (SELECT lang, unnest([{'a': w[i], 'b': w[i + 1], 'c': w[i + 2]} FOR i IN range(1, len(w) - 1)]) AS p FROM lists) GROUP BY ALL HAVING count(*) >= 10
), cover AS (
  SELECT lang, x, y, max(f) AS longer FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL
), judged AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, l.f AS l, r.f AS r, (1000000::HUGEINT * f2.f * f2.f) // (l.f::HUGEINT * r.f) AS score
  FROM f2 LEFT JOIN cover USING (lang, x, y) JOIN f1 l ON l.lang = f2.lang AND l.x = f2.x JOIN f1 r ON r.lang = f2.lang AND r.x = f2.y WHERE longer IS NULL OR 100 * longer < 50 * f2.f
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN late < early THEN l2 ELSE l1 END, CASE WHEN late < early THEN r2 ELSE r1 END, least(early, late) FROM (
    SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z AS phrase, f3.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
      (1000000::HUGEINT * f3.f * f3.f) // (x.f::HUGEINT * yz.f) AS early, (1000000::HUGEINT * f3.f * f3.f) // (xy.f::HUGEINT * z.f) AS late
    FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.x = f3.x JOIN f1 z ON z.lang = f3.lang AND z.x = f3.z
      JOIN f2 xy ON xy.lang = f3.lang AND xy.x = f3.x AND xy.y = f3.y JOIN f2 yz ON yz.lang = f3.lang AND yz.x = f3.y AND yz.y = f3.z)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM judged
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY 1) USING (lang) WHERE rank <= 2000
""",
}
