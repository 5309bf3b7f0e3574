"""From pages to items: containers, fields, links and provenance, all on the node array."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.functions.matching import keeps, keyword_matches
from pagewatch.functions.text import bound, clean
from pagewatch.functions.urls import resolve
from pagewatch.operators import selectors as css
from pagewatch.operators.nodes import document, repaired, second_reading
from pagewatch.sources.pages import short_batches
from pagewatch.spec import FieldSpec, JobSpec


def parse_pages(pages: DataFrame, body: str = "html", keep_body: bool = False, repair: bool = False) -> DataFrame:
    """Add ``nodes`` and ``segments``, as written or as a browser's tree; the body itself is dropped unless asked for."""
    short_batches(pages.sparkSession)
    parsed = pages.withColumn("_document", (repaired if repair else document)(F.col(body)))
    parsed = parsed.withColumns({"nodes": F.col("_document.nodes"), "segments": F.col("_document.segments")})
    return parsed.drop("_document") if keep_body else parsed.drop("_document", body)


def raw_text(node: Column, segments: Column) -> Column:
    return F.array_join(F.slice(segments, node["seg_from"] + 1, node["seg_to"] - node["seg_from"]), " ")


def attribute_of(node: Column, name: str) -> Column:
    return clean(F.element_at(node["attrs"], F.lit(name.lower())))


def raw_value(node: Column, attr: str, segments: Column) -> Column:
    """Undecoded text or attribute of a node; NULL when there is no node or attribute."""
    if attr.lower() != "text":
        return F.element_at(node["attrs"], F.lit(attr.lower()))
    return bound(node, lambda n: F.when(n.isNotNull(), raw_text(n, segments)))


def field_values(found: list[tuple[FieldSpec, Column]], segments: Column, base: Column) -> Column:
    """Values of all fields in order, empty for what is missing. Only href is made absolute.

    Decoding and resolving stand in the plan once for all fields, not once per field.
    """
    values = F.transform(F.array(*[raw_value(n, f.attr, segments) for f, n in found]), lambda v: F.coalesce(clean(v), F.lit("")))
    is_link = [f.attr.lower() == "href" for f, _ in found]
    if not any(is_link):
        return values
    flags = F.array(*[F.lit(flag) for flag in is_link])
    return F.transform(values, lambda v, i: F.when(F.get(flags, i), resolve(base, v)).otherwise(v))


def outer_html(node: Column, body: Column) -> Column:
    return F.coalesce(F.substring(body, node["start"] + 1, node["end"] - node["start"]), F.lit(""))


@dataclass(frozen=True)
class Plan:
    """How the selectors of a specification are read: literally on the page as written, or as CSS on a browser's tree.

    A page on which the literal form finds nothing is read again as CSS. A field that the literal form cannot read is
    looked up as CSS in the item's own text, which becomes a tree of its own.
    """

    spec: JobSpec
    strict_raw: bool = False

    @property
    def page_parser(self) -> str:
        return "raw" if css.literal_only(self.spec.selector) else "dom"

    @property
    def second_try(self) -> bool:
        """Whether pages without a literal match can be read as CSS."""
        try:
            css.read_css(self.spec.selector)
            return self.page_parser == "raw" and all(f.selector == "" or css.read_css(f.selector) for f in self.spec.fields)
        except ValueError:
            return False

    def field_parser(self, field: FieldSpec) -> str:
        if self.page_parser == "dom":
            return "dom"
        if field.selector == "" or css.read_path(field.selector) is None:
            return "dom-fallback"
        return "raw" if self.strict_raw or css.literal_only(field.selector) else "dom-fallback"

    @property
    def in_fragments(self) -> bool:
        return any(f.selector and self.field_parser(f) == "dom-fallback" for f in self.spec.fields)

    def containers(self, nodes: Column) -> Column:
        """The literal matches."""
        return css.select_path(nodes, css.read_path(self.spec.selector))


def _read(pages: DataFrame, plans: Sequence[Plan], seen: Sequence[Column], body: str) -> DataFrame:
    """The trees that the plans need of the pages they see: ``nodes`` and ``segments`` as written, and in ``_second`` the
    tree that a browser makes, of pages on which some plan needs it, and the trees of items for plans that need those."""
    short_batches(pages.sparkSession)
    literal = [(k, plan) for k, plan in enumerate(plans) if plan.page_parser == "raw"]
    # With lambdas in the input of a Python step Spark may fail to recognise the step, and it may repeat a step whose
    # output is the input of another, so trees, matches and texts are kept in columns of their own: the optimizer does
    # not move what depends on a random number; its whole part is always 0, which Spark does not know.
    apart = F.floor(F.rand(0)) == 0
    if literal:
        pages = parse_pages(pages, body, keep_body=True).withColumns({c: F.when(apart, F.col(c)) for c in ("nodes", "segments")})
        pages = pages.withColumns({f"_found_{k}": F.when(apart & seen[k], plan.containers(F.col("nodes"))) for k, plan in literal})
    inner = [k for k, plan in literal if plan.in_fragments]
    pages = pages.withColumns({f"_texts_{k}": F.when(apart, F.transform(f"_found_{k}", lambda n: outer_html(n, F.col(body)))) for k in inner}) if inner else pages
    wanted = [seen[k] for k, plan in enumerate(plans) if plan.page_parser == "dom"]
    wanted += [F.size(f"_found_{k}") == 0 for k, plan in literal if plan.second_try]
    if not wanted and not inner:
        return pages
    whole = F.when(reduce(lambda a, b: a | b, wanted), F.col(body)) if wanted else F.lit(None).cast("string")
    return pages.withColumn("_second", second_reading(whole, [F.col(f"_texts_{k}") for k in inner])).drop(*[f"_texts_{k}" for k in inner])


def _page_items(k: int, plans: Sequence[Plan], base: str, body: str, debug: bool) -> Column:
    """The items of one page for the k-th specification, before keyword filtering."""
    plan, found_here = plans[k], F.col(f"_found_{k}")
    fragment = sum(p.page_parser == "raw" and p.in_fragments for p in plans[:k])
    origin = F.col("url") if base == "page" else F.lit(plan.spec.url)
    fields = {f.name: f for f in plan.spec.fields}
    names = F.array(*[F.lit(name) for name in fields])

    def item(root: Column, parser: str, found: list[tuple[str, Column, Column, Column]]) -> Column:
        """``found`` holds the parser, the node, the segments it points into and the text it is a part of, field by field."""
        same = all(segments is found[0][2] for _, _, segments, _ in found)
        if same:
            values = field_values([(f, x[1]) for f, x in zip(fields.values(), found)], found[0][2], origin)
        else:
            values = F.concat(*[field_values([(f, x[1])], x[2], origin) for f, x in zip(fields.values(), found)])
        columns = [F.map_from_arrays(names, values).alias("fields")]
        if debug:
            matched = F.array(*[outer_html(node, text) for _, node, _, text in found])
            columns += [
                F.lit(parser).alias("parser"),
                F.map_from_arrays(names, F.array(*[F.lit(x[0]) for x in found])).alias("field_parsers"),
                outer_html(root, F.col(body)).alias("parent_html"),
                F.map_from_arrays(names, matched).alias("field_match_html"),
            ]
        return F.struct(*columns)

    def as_css() -> Column:
        nodes, segments = F.col("_second.tree.nodes"), F.col("_second.tree.segments")

        def one(root: Column) -> Column:
            own = [root if f.selector == "" else css.css_first_within(nodes, root, css.read_css(f.selector), whole_page=True) for f in fields.values()]
            return item(root, "dom", [("dom", node, segments, F.col(body)) for node in own])

        return F.transform(css.select_css(nodes, css.read_css(plan.spec.selector)), one)

    def literally() -> Column:
        nodes, segments = F.col("nodes"), F.col("segments")

        def one(root: Column, at: Column) -> Column:
            own = F.get(F.get(F.col("_second.items"), F.lit(fragment)), at) if plan.in_fragments else None
            found = []
            for f in fields.values():
                parser = plan.field_parser(f)
                if f.selector == "":
                    found.append((parser, root, segments, F.col(body)))
                elif parser == "raw":
                    found.append((parser, css.select_first_within(nodes, root, css.read_path(f.selector)), segments, F.col(body)))
                else:
                    inside = css.css_first_within(own["nodes"], F.get(own["nodes"], F.lit(0)), css.read_css(f.selector), whole_page=False)
                    found.append((parser, inside, own["segments"], outer_html(root, F.col(body))))
            return item(root, "raw", found)

        return F.transform(found_here, one)

    if plan.page_parser == "dom":
        return as_css()
    if not plan.second_try:
        return literally()
    return F.when(F.size(found_here) > 0, literally()).otherwise(F.coalesce(as_css(), F.array()))


def extract_pages(
    pages: DataFrame, spec: JobSpec, base: str = "page", strict_raw: bool = False, body: str = "html"
) -> DataFrame:
    """One row per page: ``items`` (before keyword filtering) and ``selector_matches``.

    Fields are read inside the item array, so the node array is never copied per item. ``base`` names what relative
    links are resolved against: the page or the job address. The body stays only for debug specifications.
    """
    plan = Plan(spec, strict_raw)
    read = _read(pages, [plan], [F.lit(True)], body)
    kept = [c for c in pages.columns if spec.debug or c != body]
    return read.select(*kept, _page_items(0, [plan], base, body, spec.debug).alias("items")).withColumn("selector_matches", F.size("items"))


def on_targets(spec: JobSpec) -> Column:
    """The pages of a job's own address batch."""
    return F.col("url").isin(spec.targets)


def extract_many(
    pages: DataFrame, specs: Sequence[JobSpec], own: Callable[[JobSpec], Column] | None = on_targets, base: str = "page",
    debug: bool = False, body: str = "html",
) -> DataFrame:
    """Kept items of several jobs from one reading of the pages.

    ``own`` tells which pages a job sees (its address batch unless said otherwise, all when None); a page that no job
    sees is not read at all.
    """
    if own:
        pages = pages.where(reduce(lambda a, b: a | b, [own(spec) for spec in specs]))
    plans = [Plan(spec) for spec in specs]
    parsed = _read(pages, plans, [own(spec) if own else F.lit(True) for spec in specs], body)
    kept = [c for c in pages.columns if debug or c != body]

    def of_job(k: int, plan: Plan) -> Column:
        items = _page_items(k, plans, base, body, debug)
        seen = F.when(own(plan.spec), items) if own else items
        return F.struct(F.lit(plan.spec.job_id).alias("job_id"), seen.alias("items"))

    rows = parsed.select(*kept, F.inline_outer(F.array(*[of_job(k, plan) for k, plan in enumerate(plans)])))
    items = _exploded(rows.where(F.col("items").isNotNull()).withColumn("selector_matches", F.size("items")))
    matches = keep = F
    for spec in specs:
        mine = F.col("job_id") == spec.job_id
        matches = matches.when(mine, keyword_matches(F.col("fields"), spec.keywords, spec.field_names, spec.search_fields))
        keep = keep.when(mine, F.lit(not spec.keywords))
    matched = items.withColumn("matches", matches)
    return matched.where(keep | (F.size("matches") > 0)).drop(body)


def extract_layouts(pages: DataFrame, specs: Sequence[JobSpec], layouts: str, body: str = "html") -> DataFrame:
    """One row per page and layout that it is read by: ``layout`` (the place in ``specs``), ``items`` and ``selector_matches``.

    The array column ``layouts`` of a page tells which; a page is parsed once for all. Links are resolved against the page.
    """
    plans = [Plan(spec) for spec in specs]
    asked = [F.array_contains(layouts, F.lit(k)) for k in range(len(specs))]
    read = _read(pages, plans, asked, body)
    rows = [
        F.struct(F.lit(k).alias("layout"), F.when(asked[k], _page_items(k, plans, "page", body, False)).alias("items"))
        for k in range(len(specs))
    ]
    kept = [c for c in pages.columns if c not in (body, layouts)]
    found = read.select(*kept, F.inline_outer(F.array(*rows))).where(F.col("items").isNotNull())
    return found.withColumn("selector_matches", F.size("items"))


def exploded(extracted: DataFrame) -> DataFrame:
    """One row per item of ``items``, with its place ``item_ord``."""
    return _exploded(extracted)


def _exploded(extracted: DataFrame) -> DataFrame:
    # The outer form keeps Spark from placing a size(items) filter below the parse, which would run it twice.
    rows = extracted.select(
        *[c for c in extracted.columns if c != "items"], F.posexplode_outer("items").alias("item_ord", "_item")
    )
    return rows.where(F.col("_item").isNotNull()).select("*", "_item.*").drop("_item")


def items_of(extracted: DataFrame, spec: JobSpec) -> DataFrame:
    """One row per kept item: ``job_id``, position on the page, fields and keyword matches."""
    return with_matches(_exploded(extracted).withColumn("job_id", F.lit(spec.job_id)), spec)


def with_matches(items: DataFrame, spec: JobSpec) -> DataFrame:
    """Attach keyword matches and drop items without any, when the job has keywords."""
    matches = keyword_matches(F.col("fields"), spec.keywords, spec.field_names, spec.search_fields)
    matched = items.withColumn("matches", matches)
    return matched.where(keeps(spec.keywords, F.col("matches"))) if spec.keywords else matched


def extract_items(pages: DataFrame, spec: JobSpec, base: str = "page", strict_raw: bool = False, body: str = "html") -> DataFrame:
    items = items_of(extract_pages(pages, spec, base, strict_raw, body), spec)
    return items.drop(body) if spec.debug else items


def pivot_fields(items: DataFrame, spec: JobSpec) -> DataFrame:
    """One string column per declared field in place of the map."""
    columns = [F.coalesce(F.element_at("fields", F.lit(name)), F.lit("")).alias(name) for name in spec.field_names]
    return items.select(*[c for c in items.columns if c != "fields"], *columns)


def page_titles(pages: DataFrame, body: str = "html") -> DataFrame:
    """Text of the first title element, read straight from the body without parsing the page."""
    return pages.withColumn("title", F.regexp_extract(body, r"(?s)<title>(.*?)</title>", 1)).drop(body)


def page_links(pages: DataFrame, selector: str = "a", body: str = "html") -> DataFrame:
    """(src, dst, pos) for every matching element with an href."""
    nodes = F.col("nodes")
    found = css.select_css(nodes, css.read_css(selector))
    links = F.transform(found, lambda n: resolve(F.col("url"), attribute_of(n, "href")))
    rows = parse_pages(pages, body).select(F.col("url").alias("src"), F.posexplode_outer(links).alias("pos", "dst"))
    return rows.where(F.col("dst") != "").select("src", "dst", "pos")


def routed(pages: DataFrame, spec: JobSpec) -> DataFrame:
    """Pages of the job's own address batch, by exact address."""
    return pages.where(on_targets(spec))


def preview(pages: DataFrame, spec: JobSpec, rows: int = 1) -> DataFrame:
    """Items of the first pages with provenance, before anything is stored."""
    return extract_items(pages.limit(rows), replace(spec, debug=True))
