"""DuckDB counterparts: the plain definition of each result, by all pairs or all matches."""

#: Smallest id reachable over the links (a, b), both directions present, of the vertices v.
REACHED = """
reached AS (
  SELECT v, v AS c FROM vertices
  UNION
  SELECT l.b, r.c FROM reached r JOIN links l ON l.a = r.v
)"""

NEAR_COPIES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i : i + 3])) END AS s
  FROM words
),
flat AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
both_have AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM flat x JOIN flat y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL
),
close AS (
  SELECT a, b FROM both_have JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)
),
links AS (SELECT a, b FROM close UNION SELECT b, a FROM close),
vertices AS (SELECT doc_id AS v FROM documents),
{REACHED},
least_of AS (SELECT v, min(c) AS component_id FROM reached GROUP BY v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least_of l ON l.v = s.doc_id
"""

NEAR_VECTORS = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9
),
vertices AS (SELECT vec_id AS v FROM embeddings),
{REACHED},
least_of AS (SELECT v, min(c) AS component_id FROM reached GROUP BY v),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v AS vec_id, coalesce(n, 0) AS n_links, component_id, v = component_id AS kept FROM least_of LEFT JOIN counts ON a = v
"""

CONTAINED_ITEMS = """
WITH item_words AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
),
doc_words AS (
  SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents
),
item_flat AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS wide, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: w[i : i + least(len(w), 5) - 1])) AS shingle
  FROM item_words WHERE len(w) > 0
),
widths AS (SELECT DISTINCT wide FROM item_flat),
doc_flat AS (
  SELECT DISTINCT doc_id, wide, unnest(list_transform(range(1, len(w) - wide + 2), lambda i: w[i : i + wide - 1])) AS shingle FROM doc_words, widths WHERE len(w) >= wide
),
sizes AS (SELECT item_id, count(*) AS n FROM item_flat GROUP BY item_id)
SELECT d.doc_id, i.item_id, count(*) AS n_found, s.n AS n_shingles
FROM doc_flat d JOIN item_flat i ON d.wide = i.wide AND d.shingle = i.shingle JOIN sizes s ON s.item_id = i.item_id
GROUP BY d.doc_id, i.item_id, s.n HAVING 100 * count(*) >= 80 * s.n
"""


def _spans(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Matches of a rule with their places: the pieces between matches and the matches, in turn, add up to them."""
    value = pattern.replace("'", "''")
    return f"""
{kind}_parts AS (
  SELECT n, string_split_regex(t, '{value}') AS gaps, regexp_extract_all(t, '{value}', 0) AS found, regexp_extract_all(t, '{value}', {group}) AS held FROM texts
),
{kind}_spans AS (
  SELECT n, {place} AS place, '{kind}' AS kind, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1 : i - 1], lambda g: length(g))), 0) AS start, length(found[i]) AS long
  FROM {kind}_parts, unnest(range(1, len(found) + 1)) AS u(i) WHERE length(held[i]) >= {least}
)"""


SECRETS = f"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
{_spans(0, "assign", r"((?i:password|passwd|secret|token|api_?key))[" + chr(34) + r"']?\x20*[:=]\x20*[" + chr(34) + r"']?([A-Za-z0-9+/_.=-]+)", 2, 8)},
{_spans(1, "access", "AKIA[A-Z0-9]+", 0, 16)},
{_spans(2, "hex", "[0-9a-f]+", 0, 32)},
spans AS (SELECT * FROM assign_spans UNION ALL SELECT * FROM access_spans UNION ALL SELECT * FROM hex_spans),
listed AS (
  SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(concat(kind, ':', CAST(start AS BIGINT), ':', CAST(start + long AS BIGINT)), ',' ORDER BY start, place) AS s
  FROM spans GROUP BY n
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans
FROM texts LEFT JOIN listed USING (n)
"""

FILTER_AUDIT = """
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
),
first AS (SELECT t, min(doc_id) AS first FROM words GROUP BY t),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT d.part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 5 * length(d.t),
    regexp_matches(d.t, '[#$%&*|]'), coalesce(d.doc_id > f.first, false)] AS fails, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic
  FROM words d LEFT JOIN first f ON f.t = d.t LEFT JOIN marks m ON m.doc_id = d.doc_id
),
counted AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT '' AS o UNION ALL SELECT o || x FROM orders, letters WHERE NOT contains(o, x)),
steps AS (SELECT o, CAST(step AS INTEGER) AS step, o[step] AS own FROM orders, range(1, 6) AS s(step) WHERE length(o) = 5),
seen AS (
  SELECT part, o, step, own, n, n_good, n_toxic, fails[strpos('ABCDE', own)] AS fails_own,
    len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[strpos('ABCDE', x)] AND strpos(o, x) < step)) AS earlier, len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[strpos('ABCDE', x)] AND x <> own)) AS others
  FROM counted, steps
),
told AS (
  SELECT part, o AS filter_order, step, own, coalesce(sum(n) FILTER (NOT fails_own AND earlier = 0), 0) AS kept, coalesce(sum(n) FILTER (fails_own AND earlier = 0), 0) AS removed,
    coalesce(sum(n) FILTER (fails_own AND earlier > 0), 0) AS redundant, coalesce(sum(n) FILTER (fails_own AND others = 0), 0) AS unique_fails,
    coalesce(sum(n_good) FILTER (fails_own AND earlier = 0), 0) AS good_lost, coalesce(sum(n_toxic) FILTER (fails_own AND earlier = 0), 0) AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM told
"""
