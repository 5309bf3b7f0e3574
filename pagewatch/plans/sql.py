"""Pieces of SQL shared by the counterparts of registered queries."""

from __future__ import annotations

from functools import reduce

from pagewatch.functions.text import NAMED_ENTITIES

SPACES = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def squeeze(value: str) -> str:
    return f"trim(regexp_replace({value}, '{SPACES}', ' ', 'g'))"


def named_entities(value: str) -> str:
    return reduce(lambda text, pair: f"replace({text}, {quoted(pair[0])}, {quoted(pair[1])})", NAMED_ENTITIES, value)


def clean(value: str) -> str:
    return squeeze(named_entities(value))


def ascii_lower(value: str) -> str:
    return f"translate({value}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


# Every list entry of the navigation with its place on the page.
LIST_ITEMS = """
    SELECT page_id, url, CAST(i - 1 AS INTEGER) AS item_ord, hrefs[i] AS href, texts[i] AS txt, len(hrefs) AS matches FROM (
        SELECT page_id, url,
               regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs,
               regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS texts
        FROM pages) AS found, unnest(generate_series(1, len(hrefs))) AS place(i)
"""

ORIGIN = "regexp_extract(url, '^[a-z]+://[^/]*', 0)"

# A stack machine over the tags of every page: one row per node with the names and numbers of its open ancestors.
NODES = r"""
    tokens AS (
        SELECT page_id, regexp_extract_all(html, '<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1) AS tags FROM pages
    ),
    walk AS (
        SELECT page_id, 0 AS step_no, tags, 0 AS nodes, CAST([] AS VARCHAR[]) AS open_tags, CAST([] AS INTEGER[]) AS open_ids,
               CAST(NULL AS VARCHAR) AS tag, CAST(NULL AS INTEGER) AS id, CAST([] AS VARCHAR[]) AS above_tags,
               CAST([] AS INTEGER[]) AS above_ids
        FROM tokens
        UNION ALL
        SELECT page_id, step_no + 1, tags,
               CASE WHEN opens THEN nodes + 1 ELSE nodes END,
               CASE WHEN opens AND void THEN open_tags WHEN opens THEN list_append(open_tags, name)
                    WHEN depth > 0 THEN open_tags[1:depth - 1] ELSE open_tags END,
               CASE WHEN opens AND void THEN open_ids WHEN opens THEN list_append(open_ids, nodes)
                    WHEN depth > 0 THEN open_ids[1:depth - 1] ELSE open_ids END,
               CASE WHEN opens THEN name END, CASE WHEN opens THEN nodes END, open_tags, open_ids
        FROM (
            SELECT *, NOT starts_with(tags[step_no + 1], '/') AS opens, lower(ltrim(tags[step_no + 1], '/')) AS name,
                   lower(tags[step_no + 1]) IN ('br', 'meta') AS void,
                   CASE WHEN list_contains(open_tags, lower(ltrim(tags[step_no + 1], '/')))
                        THEN len(open_tags) - list_position(list_reverse(open_tags), lower(ltrim(tags[step_no + 1], '/'))) + 1
                        ELSE 0 END AS depth
            FROM walk WHERE step_no < len(tags)) AS current_tag
    ),
    nodes AS (
        SELECT page_id, id, tag, above_tags, above_ids, coalesce(above_ids[len(above_ids)], -1) AS parent
        FROM walk WHERE id IS NOT NULL
    )
"""


def links(pages: str = "pages") -> str:
    """Made-up page graph: two targets per page, by page number."""
    return f"""
        SELECT page_id AS src, (7 * page_id + 3) % (SELECT count(*) FROM {pages}) AS dst, 0 AS pos FROM {pages}
        UNION ALL
        SELECT page_id, (3 * page_id + 1) % (SELECT count(*) FROM {pages}), 1 FROM {pages}
    """
