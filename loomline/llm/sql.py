"""DuckDB SQL of the queries in queries.py that SQL can express over whole tables."""

from __future__ import annotations

#: All pairs of one project are compared here, which is slow beyond small tables, and has no blocking to get wrong.
P4 = r"""
WITH r0 AS (
  SELECT DISTINCT id, project_id, created_at, CASE WHEN regexp_matches(file_hash, '^\s*[A-Za-z0-9+/_-]{43}=?\s*$') AND regexp_matches(file_hash, '[G-Zg-z+/_]')
      THEN lower(hex(from_base64(replace(replace(regexp_extract(file_hash, '[A-Za-z0-9+/_-]{43}'), '-', '+'), '_', '/') || '='))) ELSE regexp_replace(regexp_replace(lower(trim(file_hash)), '^\s*(sha[-_ ]?256|0x)[:=\s]*', ''), '[^0-9a-f]', '', 'g') END AS h,
    CASE WHEN trim(relative_path) <> '' THEN relative_path ELSE filename END AS p
  FROM files WHERE id IS NOT NULL AND project_id IS NOT NULL AND created_at IS NOT NULL AND file_hash IS NOT NULL),
r1 AS (SELECT * EXCLUDE (p), '/' || replace(trim(lower(strip_accents(CASE WHEN contains(p, '%') THEN url_decode(p) ELSE p END))), '\', '/') AS p FROM r0 WHERE length(h) >= 8 AND p IS NOT NULL),
r2 AS (SELECT * EXCLUDE (p), regexp_replace(regexp_replace(regexp_replace(p, '^/[a-z]:', '/'), '/(\s*\.?/)+', '/', 'g'), '^(/|\./|(upload|raw_source|tmp|temp|extract|extracted|unzipped|downloads?)/|[^/]+-(main|master)/)+', '') AS p FROM r1),
r3 AS (SELECT * EXCLUDE (p), regexp_replace(regexp_replace(trim(p), '(\.(bak|orig|old|tmp|backup|save|swp)|~)+$', ''), '([ _\-]*\(\d+\)|[ _\-]+(copy|kopie|copia|copie|kopia)[ _\-]*\(?\d*\)?)+(\.[a-z0-9]+)?$', '\3') AS p FROM r2),
r AS (SELECT * EXCLUDE (p), regexp_replace(p, '[^\p{L}\p{N}./]+', '', 'g') AS p FROM r3),
hit AS (
  SELECT b.id, arg_min(a.id, ROW(a.created_at, a.id)) AS first FROM r a JOIN r b ON a.project_id = b.project_id AND a.created_at < b.created_at
  WHERE (a.p = b.p OR (regexp_replace(a.p, '\D+', '', 'g') = regexp_replace(b.p, '\D+', '', 'g') AND least(length(a.p), length(b.p)) >= 6 AND abs(length(a.p) - length(b.p)) <= 1 AND damerau_levenshtein(a.p, b.p) <= 1))
    AND (a.h = b.h OR left(a.h, length(b.h)) = b.h OR left(b.h, length(a.h)) = a.h OR (abs(length(a.h) - length(b.h)) <= 2 AND levenshtein(a.h, b.h) <= 2)
      OR (least(length(a.h), length(b.h)) < 56 AND levenshtein(left(a.h, least(length(a.h), length(b.h))), left(b.h, least(length(a.h), length(b.h)))) <= 2))
  GROUP BY b.id)
SELECT least(id, first) AS id_1, greatest(id, first) AS id_2 FROM hit WHERE id <> first"""

ORACLES: dict[str, str] = {"p4_found": P4, "p6_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents"}
