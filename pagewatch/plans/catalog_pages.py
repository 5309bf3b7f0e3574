"""Queries over raw pages: scans, parsing, selectors, values and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewatch.functions import text, urls
from pagewatch.operators import extract, frontier, selectors
from pagewatch.operators.jobs import extract_jobs
from pagewatch.plans import sql
from pagewatch.plans.registry import query
from pagewatch.sources.pages import guarded, scan, scan_pages
from pagewatch.spec import FieldSpec, JobSpec, shorthand

NAV = JobSpec("Nav Links", "https://monitor.example.com/list", "nav li", ["text:a", "link:a@href"], keywords=["the", "UND", " ", "les"])


def counts_of(spark: SparkSession, folder: str, wanted: list[str], literal: bool = False) -> DataFrame:
    """(page_id, selector, n) for several selectors over one parse."""
    nodes = F.col("nodes")

    def found(selector: str):
        if literal:
            return selectors.select_path(nodes, selectors.read_path(selector))
        return selectors.select_css(nodes, selectors.read_css(selector))

    pairs = F.array(*[F.struct(F.lit(s).alias("selector"), F.size(found(s)).cast("bigint").alias("n")) for s in wanted])
    return extract.parse_pages(scan_pages(spark, folder), repair=not literal).select("page_id", F.inline_outer(pairs))


@query("s01_page_scan", "SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS size, CAST(length(html) AS BIGINT) AS chars FROM pages")
def page_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "pages").select(
        "page_id", "url", F.octet_length("html").cast("bigint").alias("size"), F.length("html").cast("bigint").alias("chars")
    )


@query("s03_body_guard", """
    SELECT page_id, CASE WHEN strlen(html) > 4096 THEN 'size' END AS error_kind,
           CASE WHEN strlen(html) > 4096 THEN 'response body exceeds 4096 bytes' END AS error FROM pages
""")
def body_guard(spark: SparkSession, folder: str) -> DataFrame:
    return guarded(scan(spark, folder, "pages"), limit=4096).select("page_id", "error_kind", "error")


@query("x01_node_parse", f"""
    WITH RECURSIVE {sql.NODES},
    inside AS (SELECT page_id, unnest(above_ids) AS id, id AS below FROM nodes),
    ends AS (SELECT page_id, id, max(below) AS last FROM inside GROUP BY page_id, id)
    SELECT n.page_id, n.id, n.tag, n.parent, coalesce(e.last, n.id) AS last, CAST(len(n.above_ids) AS INTEGER) AS depth
    FROM nodes n LEFT JOIN ends e ON e.page_id = n.page_id AND e.id = n.id
""")
def node_parse(spark: SparkSession, folder: str) -> DataFrame:
    nodes = F.col("nodes")
    # Ancestors are the earlier nodes whose range reaches this one.
    rows = F.transform(
        nodes,
        lambda n: F.struct(
            n["id"].alias("id"), n["tag"].alias("tag"), n["parent"].alias("parent"), n["last"].alias("last"),
            F.size(F.filter(F.slice(nodes, F.lit(1), n["id"]), lambda a: a["last"] >= n["id"])).alias("depth"),
        ),
    )
    return extract.parse_pages(scan_pages(spark, folder)).select("page_id", F.inline_outer(rows))


@query("x02_simple_selector", """
    SELECT page_id, s.selector, CAST(CASE s.selector
        WHEN '.ad' THEN len(regexp_extract_all(html, '<div class="ad">', 0))
        WHEN 'DIV.ad' THEN len(regexp_extract_all(html, '<div class="ad">', 0))
        WHEN 'nav > ul > li' THEN len(regexp_extract_all(html, '<li>', 0))
        WHEN '>article h1' THEN len(regexp_extract_all(html, '<h1>', 0))
        WHEN 'html' THEN len(regexp_extract_all(html, '<html ', 0))
        ELSE 0 END AS BIGINT) AS n
    FROM pages, (VALUES ('.ad'), ('DIV.ad'), ('div.AD'), ('nav > ul > li'), ('nav > li'), ('>article h1'), ('html'), ('#main')) AS s(selector)
""")
def simple_selector(spark: SparkSession, folder: str) -> DataFrame:
    return counts_of(
        spark, folder, [".ad", "DIV.ad", "div.AD", "nav > ul > li", "nav > li", ">article h1", "html", "#main"], literal=True
    )


@query("x03_select_all", f"""
    WITH RECURSIVE {sql.NODES}
    SELECT p.page_id, s.selector, CAST(CASE s.selector
        WHEN 'p b' THEN (SELECT coalesce(sum(len(list_filter(above_tags, lambda t: t = 'p'))), 0) FROM nodes n WHERE n.page_id = p.page_id AND tag = 'b')
        WHEN 'article p' THEN (SELECT count(*) FROM nodes n WHERE n.page_id = p.page_id AND tag = 'p')
        WHEN 'p > p' THEN (SELECT count(*) FROM nodes n WHERE n.page_id = p.page_id AND tag = 'p' AND above_tags[len(above_tags)] = 'p')
        ELSE (SELECT count(*) FROM nodes n WHERE n.page_id = p.page_id AND tag = 'a') END AS BIGINT) AS n
    FROM pages p, (VALUES ('p b'), ('article p'), ('p > p'), ('nav ul li a')) AS s(selector)
""")
def select_all(spark: SparkSession, folder: str) -> DataFrame:
    return counts_of(spark, folder, ["p b", "article p", "p > p", "nav ul li a"], literal=True)


@query("x04_select_first", f"""
    SELECT page_id, {sql.clean('''regexp_extract(html, '<nav><ul><li><a href="([^"]*)">([^<]*)', 2)''')} AS first_text,
           {sql.ORIGIN} || {sql.clean('''regexp_extract(html, '<nav><ul><li><a href="([^"]*)">([^<]*)', 1)''')} AS first_link,
           {sql.clean("regexp_replace(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<[^>]*>', ' ', 'g')")} AS own_text,
           '' AS missing
    FROM pages
""")
def select_first(spark: SparkSession, folder: str) -> DataFrame:
    spec = JobSpec("First", "https://monitor.example.com", "nav", ["first_text:li a", "first_link:ul > li a@href", "own_text:nav", "missing:h6"])
    return extract.pivot_fields(extract.extract_items(scan_pages(spark, folder), spec), spec).select("page_id", *spec.field_names)


@query("x05_text_values", f"""
    SELECT page_id,
           {sql.clean("regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[^>]*>', ' ', 'g')")} AS article,
           {sql.clean("regexp_extract(html, '<footer>(.*?)</footer>', 1, 's')")} AS footer,
           {sql.clean("regexp_extract(html, '<script>(.*?)</script>', 1, 's')")} AS script
    FROM pages
""")
def text_values(spark: SparkSession, folder: str) -> DataFrame:
    spec = JobSpec("Texts", "https://monitor.example.com", "html", ["article:article", "footer:footer", "script:script"])
    return extract.pivot_fields(extract.extract_items(scan_pages(spark, folder), spec), spec).select("page_id", *spec.field_names)


@query("x06_attribute_values", """
    SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<meta charset="([^"]*)"', 1) AS charset,
           'ad' AS box, '' AS missing
    FROM pages
""")
def attribute_values(spark: SparkSession, folder: str) -> DataFrame:
    spec = JobSpec("Attributes", "https://monitor.example.com", "html", ["lang:html@LANG", "charset:meta@charset", "box:.ad@class", "missing:h1@title"])
    return extract.pivot_fields(extract.extract_items(scan_pages(spark, folder), spec), spec).select("page_id", *spec.field_names)


COMPLEX = [
    'a[href^="/T"]', "li:first-child > a", "li:last-child", "li:nth-child(2n+1)", "li:not(:first-child)", "ul:has(a)",
    "h1 ~ p", "li + li", "title, h1", 'div[class~="ad"]', "meta[charset]", "a[href$='.']",
    "li:nth-last-of-type(2)", "ul:has(> li + li)", "body > :is(nav, article):not(:empty)", "article > p:first-of-type", "html[lang|=en]", "li:only-child, ul:only-of-type",
]


@query("x07_complex_selectors", f"""
    WITH RECURSIVE {sql.NODES}, li AS ({sql.LIST_ITEMS})
    SELECT p.page_id, s.selector, CAST(CASE s.selector
        WHEN {sql.quoted(COMPLEX[0])} THEN (SELECT count(*) FROM li WHERE li.page_id = p.page_id AND starts_with(href, '/T'))
        WHEN {sql.quoted(COMPLEX[1])} THEN least(1, (SELECT count(*) FROM li WHERE li.page_id = p.page_id))
        WHEN {sql.quoted(COMPLEX[2])} THEN least(1, (SELECT count(*) FROM li WHERE li.page_id = p.page_id))
        WHEN {sql.quoted(COMPLEX[3])} THEN (SELECT count(*) FROM li WHERE li.page_id = p.page_id AND item_ord % 2 = 0)
        WHEN {sql.quoted(COMPLEX[4])} THEN (SELECT count(*) FROM li WHERE li.page_id = p.page_id AND item_ord > 0)
        WHEN {sql.quoted(COMPLEX[5])} THEN least(1, (SELECT count(*) FROM li WHERE li.page_id = p.page_id))
        WHEN {sql.quoted(COMPLEX[6])} THEN len(regexp_extract_all(regexp_extract(html, '(?s)</h1>(.*)</article>', 1), '<p>', 0))
        WHEN {sql.quoted(COMPLEX[7])} THEN (SELECT count(*) FROM li WHERE li.page_id = p.page_id AND item_ord > 0)
        WHEN {sql.quoted(COMPLEX[8])} THEN 2
        WHEN {sql.quoted(COMPLEX[9])} THEN 1
        WHEN {sql.quoted(COMPLEX[10])} THEN 1
        WHEN {sql.quoted(COMPLEX[12])} THEN (SELECT count(*) FROM li WHERE li.page_id = p.page_id HAVING count(*) > 1) // greatest((SELECT count(*) FROM li WHERE li.page_id = p.page_id), 1)
        WHEN {sql.quoted(COMPLEX[13])} THEN CAST((SELECT count(*) FROM li WHERE li.page_id = p.page_id) > 1 AS BIGINT)
        WHEN {sql.quoted(COMPLEX[14])} THEN CASE WHEN contains(html, '<body>') THEN 2 ELSE 0 END
        WHEN {sql.quoted(COMPLEX[15])} THEN least(1, len(regexp_extract_all(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>', 0)))
        WHEN {sql.quoted(COMPLEX[16])} THEN CAST(regexp_matches(html, '<html lang="en["-]') AS BIGINT)
        WHEN {sql.quoted(COMPLEX[17])} THEN CAST((SELECT count(*) FROM li WHERE li.page_id = p.page_id) = 1 AS BIGINT) + len(regexp_extract_all(html, '<ul>', 0))
        ELSE (SELECT count(*) FROM li WHERE li.page_id = p.page_id AND ends_with(href, '.')) END AS BIGINT) AS n
    FROM pages p, (SELECT unnest([{', '.join(sql.quoted(c) for c in COMPLEX)}]) AS selector) AS s
""")
def complex_selectors(spark: SparkSession, folder: str) -> DataFrame:
    return counts_of(spark, folder, COMPLEX)


@query("x08_parser_choice", """
    SELECT 'raw' AS parser, 'raw' AS text_parser, 'raw' AS link_parser, sum(len(regexp_extract_all(html, '<li>', 0)))::BIGINT AS items FROM pages
    UNION ALL
    SELECT 'dom', 'dom', 'dom', sum(least(1, len(regexp_extract_all(html, '<li>', 0))))::BIGINT FROM pages
    UNION ALL
    SELECT 'raw', 'raw', 'dom-fallback', sum(len(regexp_extract_all(html, '<li>', 0)))::BIGINT FROM pages
""")
def parser_choice(spark: SparkSession, folder: str) -> DataFrame:
    specs = [
        JobSpec("Literal", "https://monitor.example.com", "nav li", ["text:a", "link:a@href"]),
        JobSpec("Css", "https://monitor.example.com", "li:first-child", ["text:a", "link:a@href"]),
        JobSpec("Mixed", "https://monitor.example.com", "nav li", ["text:a", "link:a[href]@href"]),
    ]
    found = extract.extract_many(scan_pages(spark, folder), specs, own=None, debug=True)
    return found.groupBy(
        "parser", F.col("field_parsers")["text"].alias("text_parser"), F.col("field_parsers")["link"].alias("link_parser")
    ).agg(F.count(F.lit(1)).alias("items"))


@query("x09_field_shorthand", """
    SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN NULL ELSE trim(c_mktsegment) END AS name,
           CASE WHEN c_nationkey < 5 THEN NULL ELSE '.' || lower(c_mktsegment) || ':x' END AS selector,
           CASE WHEN c_nationkey < 5 THEN NULL WHEN c_nationkey < 10 THEN 'text' WHEN c_nationkey < 15 THEN 'text' ELSE 'data-x@y' END AS attr
    FROM customer
""")
def field_shorthand(spark: SparkSession, folder: str) -> DataFrame:
    nation = F.col("c_nationkey")
    selector = F.concat(F.lit(" : ."), F.lower("c_mktsegment"), F.lit(":x "))
    written = (
        F.when(nation < 5, F.col("c_mktsegment"))
        .when(nation < 10, F.concat("c_mktsegment", selector))
        .when(nation < 15, F.concat("c_mktsegment", selector, F.lit("@ ")))
        .otherwise(F.concat("c_mktsegment", selector, F.lit("@ data-x@y")))
    )
    return scan(spark, folder, "customer").select("c_custkey", shorthand(written).alias("f")).select("c_custkey", "f.*")


HAY = sql.ascii_lower(f"concat_ws(' ', {sql.clean('txt')}, {sql.ORIGIN} || {sql.clean('href')})")


@query("x10_items", f"""
    SELECT page_id, item_ord, matches AS selector_matches, text, link, array_to_string(found, ',') AS matches FROM (
        SELECT page_id, item_ord, CAST(matches AS INTEGER) AS matches, {sql.clean('txt')} AS text, {sql.ORIGIN} || {sql.clean('href')} AS link,
               list_filter(['the', 'und', 'les'], lambda k: contains({HAY}, k)) AS found
        FROM ({sql.LIST_ITEMS})) WHERE len(found) > 0
""")
def items(spark: SparkSession, folder: str) -> DataFrame:
    rows = extract.pivot_fields(extract.extract_items(scan_pages(spark, folder), NAV), NAV)
    return rows.select("page_id", "item_ord", "selector_matches", "text", "link", F.array_join("matches", ",").alias("matches"))


@query("j03_jobs_over_own_pages", f"""
    SELECT 'secure_links' AS job_id, page_id, item_ord, {sql.clean('txt')} AS text FROM ({sql.LIST_ITEMS}) WHERE starts_with(url, 'https:')
    UNION ALL SELECT 'headings', page_id, 0, {sql.clean("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} FROM pages WHERE contains(url, '?')
""")
def jobs_over_own_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Two jobs over one reading of the pages, each on its own addresses."""
    links = JobSpec("Secure Links", "https://monitor.example.com", "nav li", ["text:a"])
    headings = JobSpec("Headings", "https://monitor.example.com", "article", ["text:h1"])

    def own(spec: JobSpec):
        return F.startswith("url", F.lit("https:")) if spec is links else F.contains("url", F.lit("?"))

    rows = extract.extract_many(scan_pages(spark, folder), [links, headings], own)
    return rows.select("job_id", "page_id", "item_ord", F.col("fields")["text"].alias("text"))


# Two jobs per host of the pages, and one for each scheme that wants all its pages; the jobs of some hosts are switched off.
HOST_OF = "regexp_extract(url, '://([^/]*)', 1)"
JOBS_SQL = f"""
    hosts AS (SELECT {HOST_OF} AS host, list(url) AS urls FROM pages GROUP BY 1),
    schemes AS (SELECT 'all ' || regexp_extract(url, '^[a-z]*', 0) AS host, list(url) AS urls FROM pages GROUP BY 1),
    jobs AS (
        SELECT 'Links ' || host AS name, 'links' AS layout, urls, CASE length(host) % 3 WHEN 0 THEN ['The', ' les '] WHEN 1 THEN ['und'] END AS words
        FROM hosts WHERE length(host) % 7 <> 0
        UNION ALL SELECT 'Head ' || host, 'head', urls, NULL FROM hosts
        UNION ALL SELECT 'Links ' || host, 'links', urls, ['und'] FROM schemes),
    routed AS (
        SELECT regexp_replace(lower(regexp_replace(name, '[^\\p{{L}}\\p{{N}}]', '_', 'g')), '^_+|_+$', '', 'g') AS job_id, layout, words, p.*
        FROM (SELECT name, layout, words, unnest(list_distinct(urls)) AS url FROM jobs) JOIN pages p USING (url)),
    found AS (
        SELECT job_id, words, r.page_id, i.item_ord, {sql.clean('txt')} AS text, {sql.ORIGIN.replace('url', 'r.url')} || {sql.clean('href')} AS link
        FROM routed r JOIN ({sql.LIST_ITEMS}) i ON i.page_id = r.page_id WHERE layout = 'links'
        UNION ALL SELECT job_id, NULL, page_id, 0, {sql.clean("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")}, '' FROM routed WHERE layout = 'head'),
    kept AS (
        SELECT * FROM found WHERE words IS NULL
            OR len(list_filter(words, lambda w: contains({sql.ascii_lower('text')}, {sql.ascii_lower('trim(w)')}))) > 0)
"""


def host_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """The specification table of these jobs."""
    pages = scan(spark, folder, "pages").select("url", F.regexp_extract("url", "://([^/]*)", 1).alias("host"), F.regexp_extract("url", "^[a-z]*", 0).alias("scheme"))
    hosts = pages.groupBy("host").agg(F.collect_list("url").alias("urls"))
    schemes = pages.groupBy(F.concat(F.lit("all "), "scheme").alias("host")).agg(F.collect_list("url").alias("urls"))
    no_words, rest = F.lit(None).cast("array<string>"), F.length("host") % 3
    words = F.when(rest == 0, F.array(F.lit("The"), F.lit(" les "))).when(rest == 1, F.array(F.lit("und"))).otherwise(no_words)

    def jobs(rows: DataFrame, kind: str, selector: str, fields: list[FieldSpec], words, enabled) -> DataFrame:
        read = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.selector).alias("selector"), F.lit(f.attr).alias("attr")) for f in fields])
        return rows.select(
            F.concat(F.lit(kind), "host").alias("name"), F.lit("https://monitor.example.com").alias("url"), F.lit(selector).alias("selector"), read.alias("fields"),
            words.alias("keywords"), F.array(F.lit("text")).alias("search_fields"), F.array(F.lit("text")).alias("hash_fields"), "urls", enabled.alias("enabled"),
            F.lit(None).cast("struct<enabled:boolean,url:string,headers:map<string,string>>").alias("webhook"),
        )

    links = [FieldSpec("text", "a"), FieldSpec("link", "a", "href")]
    listed = jobs(hosts, "Links ", "nav li", links, words, F.length("host") % 7 != 0)
    heads = jobs(hosts, "Head ", "article", [FieldSpec("text", "h1")], no_words, F.lit(True))
    return listed.union(heads).union(jobs(schemes, "Links ", "nav li", links, F.array(F.lit("und")), F.lit(True)))


@query("j03_many_jobs_one_parse", f"WITH {JOBS_SQL} SELECT job_id, page_id, CAST(item_ord AS INTEGER) AS item_ord, text, link FROM kept")
def many_jobs_one_parse(spark: SparkSession, folder: str) -> DataFrame:
    """All jobs of a specification table over one reading of the pages."""
    rows = extract_jobs(scan_pages(spark, folder), host_jobs(spark, folder))
    text, link = [F.coalesce(F.element_at("fields", F.lit(name)), F.lit("")).alias(name) for name in ("text", "link")]
    return rows.select("job_id", "page_id", "item_ord", text, link)


@query("x11_whitespace", f"""
    SELECT doc_id, sha256({sql.squeeze("'  ' || replace(text, ' ', chr(160) || chr(9)) || chr(10)")}) AS digest FROM documents
""")
def whitespace(spark: SparkSession, folder: str) -> DataFrame:
    spaced = F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit(" \t")), F.lit("\n"))
    return scan(spark, folder, "documents").select("doc_id", F.sha2(text.squeeze(spaced), 256).alias("digest"))


@query("x12_entities", f"""
    SELECT doc_id, sha256(text || ' <b> & "q" ''a'' &copy; ' || text || ' &#xZZ;&#65;') AS digest FROM documents
""")
def entities(spark: SparkSession, folder: str) -> DataFrame:
    # Letters of the text are written as numeric entities and must come back; the tail holds the ones that stay.
    coded = F.replace(F.replace(F.replace("text", F.lit("e"), F.lit("&#101;")), F.lit("é"), F.lit("&#xE9;")), F.lit("T"), F.lit("&#0084;"))
    whole = F.concat(coded, F.lit(" &lt;b&gt; &amp; &quot;q&quot; &#39;a&apos; &copy;&nbsp;"), coded, F.lit(" &#xZZ;&#65;"))
    return scan(spark, folder, "documents").select("doc_id", F.sha2(text.decode_entities(whole), 256).alias("digest"))


LINKS = ["/p/./q", "rel/a", "../up", "../../../x/./y//z", "?q=1", "#top", "mailto:a@b.c", "//cdn.example.com/f", "https://o.example.com/", "HTTP://o", " /pad ", ""]


@query("x13_resolve_url", f"""
    WITH given AS (SELECT page_id, url, unnest([{', '.join(sql.quoted(link) for link in LINKS)}]) AS link FROM pages),
    parts AS (SELECT *, trim(link) AS v, {sql.ORIGIN} AS origin, regexp_replace(substr(url, length({sql.ORIGIN}) + 1), '/[^/]*$', '') AS folder FROM given),
    folded AS (
        SELECT *, list_reduce(
            list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split(folder || '/' || v, '/'), lambda p: [p])),
            lambda kept, part: CASE WHEN part[1] IN ('', '.') THEN kept WHEN part[1] = '..' THEN kept[1:len(kept) - 1] ELSE kept || part END) AS kept
        FROM parts)
    SELECT page_id, link, CASE
        WHEN v = '' OR starts_with(v, '#') OR starts_with(v, 'mailto:') OR starts_with(v, 'https://') THEN v
        WHEN starts_with(v, '//') THEN regexp_extract(url, '^[a-z]+', 0) || ':' || v
        WHEN starts_with(v, '/') THEN origin || v
        ELSE origin || '/' || array_to_string(kept, '/') END AS resolved
    FROM folded
""")
def resolve_url(spark: SparkSession, folder: str) -> DataFrame:
    given = scan(spark, folder, "pages").select("page_id", "url", F.explode(F.array(*[F.lit(v) for v in LINKS])).alias("link"))
    return given.select("page_id", "link", urls.resolve(F.col("url"), F.col("link")).alias("resolved"))


@query("x14_provenance", f"""
    SELECT page_id, item_ord, 'raw' AS parser, '<li><a href="' || href || '">' || txt || '</a></li>' AS parent_html,
           '<a href="' || href || '">' || txt || '</a>' AS text_html, 'raw' AS text_parser, 'dom-fallback' AS link_parser
    FROM ({sql.LIST_ITEMS})
""")
def provenance(spark: SparkSession, folder: str) -> DataFrame:
    spec = JobSpec("Debug", "https://monitor.example.com", "nav li", ["text:a", FieldSpec("link", "a[href]", "href")], debug=True)
    return extract.extract_items(scan_pages(spark, folder), spec).select(
        "page_id", "item_ord", "parser", "parent_html", F.col("field_match_html")["text"].alias("text_html"),
        F.col("field_parsers")["text"].alias("text_parser"), F.col("field_parsers")["link"].alias("link_parser"),
    )


@query("x15_page_title", "SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title FROM pages")
def page_title(spark: SparkSession, folder: str) -> DataFrame:
    return extract.page_titles(scan(spark, folder, "pages")).select("page_id", "title")


@query("x16_link_table", f"SELECT url AS src, {sql.ORIGIN} || {sql.clean('href')} AS dst, item_ord AS pos FROM ({sql.LIST_ITEMS})")
def link_table(spark: SparkSession, folder: str) -> DataFrame:
    return extract.page_links(scan_pages(spark, folder), "a")


@query("x16_pushed_links", f"""
    WITH pushes AS (SELECT {sql.ORIGIN} || {sql.clean('href')} AS url, count(*) AS times FROM ({sql.LIST_ITEMS}) GROUP BY 1)
    SELECT url, times, url NOT IN (SELECT url FROM pages) AS fresh FROM pushes
""")
def pushed_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every link of every page pushed to the frontier, where the pages themselves are known."""
    rows = scan_pages(spark, folder)
    return frontier.admitted(extract.page_links(rows, "a").select(F.col("dst").alias("url")), rows)


@query("x13_job_address_base", f"""
    SELECT page_id, item_ord, 'https://monitor.example.com' || {sql.clean('href')} AS link FROM ({sql.LIST_ITEMS})
""")
def job_address_base(spark: SparkSession, folder: str) -> DataFrame:
    """X13 with the job's own address as base, which is what a single-page job does."""
    spec = JobSpec("Base", "https://monitor.example.com/list", "nav li", ["link:a@href"])
    rows = extract.extract_items(scan_pages(spark, folder), spec, base="job")
    return rows.select("page_id", "item_ord", F.col("fields")["link"].alias("link"))
