from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagewatch.operators import selectors
from pagewatch.operators.extract import extract_items, extract_many, extract_pages, items_of, page_links, pivot_fields
from pagewatch.spec import FieldSpec, JobSpec, load_specs

URL = "https://shop.example.com/list/today?x=1"
CARDS = """
<div class="card wide" id="one"><h2>First &amp; best</h2><a href="/a?b=1">go</a><p data-code=" K 7 ">RUST tool</p></div>
<div class="card"><h2>Second</h2><a href="next/../item">go</a><p>Other tool</p></div>
"""
MESSY = """
<section><article class=entry data-id='77'><a href=one>Outer <a href=two>Inner</a> tail<div>Block <span>nested</span><span>text</span>
<dl><dt>k</dt><dd>val<dd>last</dl></article></section>
"""


def pages(spark, *bodies):
    return spark.createDataFrame([(i, URL, b) for i, b in enumerate(bodies)], "page_id bigint, url string, html string")


def items(spark, spec, *bodies, **options):
    rows = extract_items(pages(spark, *bodies), spec, **options).orderBy("page_id", "item_ord").collect()
    return [(r["fields"], r["matches"]) for r in rows]


def test_two_cards(spark):
    spec = JobSpec("J", URL, ".card", ["title:h2", "link:a@href", "code:p@data-code", "none:h5", "gone:p@title"])
    found = items(spark, spec, CARDS)
    assert [f for f, _ in found] == [
        {"title": "First & best", "link": "https://shop.example.com/a?b=1", "code": "K 7", "none": "", "gone": ""},
        {"title": "Second", "link": "https://shop.example.com/list/item", "code": "", "none": "", "gone": ""},
    ]


def test_keywords_keep_the_count_before_filtering(spark):
    spec = JobSpec("J", URL, ".card", ["title:h2", "text:p"], keywords=["rust", " ", "ABSENT", "Rust"])
    rows = extract_pages(pages(spark, CARDS), spec)
    assert rows.select("selector_matches").first()[0] == 2
    kept = items_of(rows, spec).collect()
    assert [(r["item_ord"], r["matches"]) for r in kept] == [(0, ["rust", "rust"])]
    assert items(spark, JobSpec("J", URL, ".card", ["t:h2"], keywords=[" "]), CARDS) == []
    assert items(spark, JobSpec("J", URL, ".card", ["t:h2"], keywords=["first"], search_fields=[]), CARDS) == []
    assert len(items(spark, JobSpec("J", URL, ".card", ["t:h2"], keywords=[]), CARDS)) == 2


def test_messy_markup(spark):
    spec = JobSpec("J", URL, "section article.entry", ["all:div", "id:.entry@data-id", "dd:dl>dd", "first:a", "inner:a a@href"])
    fields = items(spark, spec, MESSY)[0][0]
    assert fields["all"] == "Block nested text k val last"
    assert (fields["id"], fields["dd"], fields["inner"]) == ("77", "val last", "https://shop.example.com/list/two")
    assert fields["first"].startswith("Outer Inner tail Block")


def test_container_is_its_own_field(spark):
    spec = JobSpec("J", URL, ".card", [FieldSpec("self", ".card", "id"), FieldSpec("empty", "", "class")])
    assert [f for f, _ in items(spark, spec, CARDS)][0] == {"self": "one", "empty": "card wide"}


@pytest.mark.parametrize(("selector", "count"), [
    ("#one", 1), ("div#one.card.wide", 1), ("div.card", 2), (".missing", 0), ("DIV", 2), (".CARD", 0), ("> h2", 2),
])
def test_literal_selectors(spark, selector, count):
    assert len(items(spark, JobSpec("J", URL, selector, ["t:h2"]), CARDS)) == count


def test_nested_ancestors_repeat_in_literal_mode_only(spark):
    body = "<div><div><p>x</p></div></div>"
    assert len(items(spark, JobSpec("J", URL, "div p", ["t:p"]), body)) == 2
    assert len(items(spark, JobSpec("J", URL, "div p:not(.a)", ["t:p"]), body)) == 1


@pytest.mark.parametrize(("selector", "texts"), [
    ('a[target="_blank"]', ["2"]), ("a[target]", ["2", "3"]), ("a:not([target])", ["1"]), ("li:nth-child(2) a", ["2"]),
    ("li:nth-child(odd)", ["1", "3"]), ("li:last-child", ["3"]), ("li + li", ["2", "3"]), ("li.x ~ li", ["2", "3"]),
    ("li:has(a[href$='c'])", ["3"]), ("li.x, li:last-child", ["1", "3"]), ("ul > li:first-child > a", ["1"]), ("a[href*='b']", ["2"]),
    ("a[rel~=me]", ["3"]), ("*[href^='/c']", ["3"]), ("li:nth-child(-n+2)", ["1", "2"]),
])
def test_css(spark, selector, texts):
    body = "<ul><li class=x><a href='/a'>1</a></li><li><a target='_blank' href='/b'>2</a></li><li><a target=t rel='you me' href='/c'>3</a></li></ul>"
    found = items(spark, JobSpec("J", URL, selector, [FieldSpec("t", "", "text")]), body)
    assert [f["t"] for f, _ in found] == texts


BROKEN = (
    "<body><ul class=n><li>one<li class=x>two <a hreflang=en-GB DATA-K=Ab href=/q>q</a><li>three</ul>"
    "<table id=t><tr><td>a<td>b<tr><td>c</table><p>first<p>second<div>third</div><p></p><!-- <p>no</p> --><span><b>only</b></span></body>"
)


@pytest.mark.parametrize(("selector", "texts"), [
    ("table > tbody > tr", ["a b", "c"]), ("li:nth-child(2)", ["two q"]), ("ul > li:last-child", ["three"]), ("tr:has(> td + td)", ["a b"]), ("#t td:only-child", ["c"]),
    ("p:nth-of-type(2)", ["second"]), ("p:last-of-type:empty", [""]), ("p:nth-last-of-type(3)", ["first"]), ("body > p:first-of-type", ["first"]), ("span > b:only-of-type", ["only"]),
    ("a[hreflang|=en]", ["q"]), ("a[hreflang|=e]", []), ("a[data-k='aB' i]", ["q"]), ("a[data-k='aB']", []), (":is(td, div):not(:empty)", ["a", "b", "c", "third"]),
    ("ul:has(> a)", []), ("ul:has(> li a)", ["one two q three"]), ("li:has(+ li.x)", ["one"]), ("body:root > ul:where(.n)", ["one two q three"]), ("td:nth-last-child(2)", ["a"]),
])
def test_css_reads_the_tree_of_a_browser(spark, selector, texts):
    found = items(spark, JobSpec("J", URL, selector, [FieldSpec("t", "", "text")]), BROKEN)
    assert [" ".join(f["t"].split()) for f, _ in found] == texts


def test_pages_without_a_literal_match_are_read_as_css(spark):
    spec = JobSpec("J", URL, "tbody > tr", ["first:td", "second:td + td"], debug=True)
    rows = spark.createDataFrame([(0, URL, BROKEN), (1, URL, "<table><tbody><tr><td>x</td><td>y</td></tr></tbody></table>"), (2, URL, "<p>nothing"), (3, URL, None), (4, URL, "")], "page_id bigint, url string, html string")
    found = extract_items(rows, spec).orderBy("page_id", "item_ord").collect()
    assert [(r["page_id"], r["parser"], r["fields"]["first"], r["fields"]["second"]) for r in found] == [(0, "dom", "a", "b"), (0, "dom", "c", ""), (1, "raw", "x", "y")]
    assert found[0]["parent_html"] == "<tr><td>a<td>b" and found[0]["field_parsers"] == {"first": "dom", "second": "dom"} and found[2]["field_parsers"]["second"] == "dom-fallback"
    assert found[2]["field_match_html"]["second"] == "<td>y</td>"
    counts = {r["page_id"]: r["selector_matches"] for r in extract_pages(rows, spec).collect()}
    assert counts == {0: 2, 1: 1, 2: 0, 3: 0, 4: 0}


def test_a_field_in_the_items_own_text_is_repaired_as_well(spark):
    spec = JobSpec("J", URL, ".card", ["cell:tbody > tr:nth-child(2) > td", "plain:b", "link:a[href]@href"])
    body = "<div class=card><b>B</b><table><tr><td>1<tr><td>2</table><a href=x>l</a></div><div class=card>none</div>"
    assert [f for f, _ in items(spark, spec, body)] == [{"cell": "2", "plain": "B", "link": "https://shop.example.com/list/x"}, {"cell": "", "plain": "", "link": ""}]


@pytest.mark.parametrize("selector", ["a[", "p::before", "a:hover", "> , x", "li +", ":nth-child(x)"])
def test_bad_css_is_an_error_on_the_driver(spark, selector):
    with pytest.raises(ValueError):
        extract_items(pages(spark, CARDS), JobSpec("J", URL, selector, ["t:a[b]"]))


def test_strict_raw_misses_silently(spark):
    body = "<div class=r><b>x</b><i>y</i></div>"
    spec = JobSpec("J", URL, ".r", ["t:b + i"])
    assert items(spark, spec, body)[0][0] == {"t": "y"}
    assert items(spark, spec, body, strict_raw=True)[0][0] == {"t": ""}


def test_debug_columns(spark):
    spec = JobSpec("J", URL, ".card", ["title:h2", "code:p[data-code]@data-code"], debug=True)
    row = extract_items(pages(spark, CARDS), spec).orderBy("item_ord").first()
    assert row["parser"] == "raw" and row["field_parsers"] == {"title": "raw", "code": "dom-fallback"}
    assert row["parent_html"].startswith('<div class="card wide"') and row["parent_html"].endswith("</div>")
    assert row["field_match_html"]["title"] == "<h2>First &amp; best</h2>"
    plain = extract_items(pages(spark, CARDS), JobSpec("J", URL, ".card", ["title:h2"]))
    assert "parent_html" not in plain.columns and "html" not in plain.columns


def test_links_and_pivot(spark):
    links = page_links(pages(spark, CARDS)).orderBy("pos").collect()
    assert [tuple(r) for r in links] == [
        (URL, "https://shop.example.com/a?b=1", 0), (URL, "https://shop.example.com/list/item", 1),
    ]
    spec = JobSpec("J", URL, ".card", ["title:h2"])
    assert pivot_fields(extract_items(pages(spark, CARDS), spec), spec).select("title").orderBy("item_ord").first()[0] == "First & best"


def test_pages_are_parsed_once(spark):
    spec = JobSpec("J", URL, ".card", ["title:h2", "link:a@href"], keywords=["first"])
    plan = extract_items(pages(spark, CARDS), spec)._jdf.queryExecution().executedPlan().toString()
    # The browser's tree is made of a body only where the literal form finds nothing.
    assert plan.count("_document(html") == 1 and plan.count("_second_reading(CASE WHEN") == 1 and "Exchange" not in plan


def test_several_jobs_share_one_parse(spark):
    rows = spark.createDataFrame([(0, "https://a/", CARDS), (1, "https://b/", CARDS), (2, "https://c/", CARDS)], "page_id bigint, url string, html string")
    specs = [
        JobSpec("A", "https://a/", ".card", ["t:h2"], keywords=["second"]), JobSpec("B", "https://b/", "h2", [FieldSpec("x", "", "text")], urls=["https://a/", "https://b/"]),
    ]
    found = extract_many(rows, specs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("_document(html") == 1 and plan.count("_second_reading(CASE WHEN") == 1
    assert sorted((r["job_id"], r["page_id"], r["item_ord"], *r["fields"].values(), len(r["matches"])) for r in found.collect()) == [
        ("a", 0, 1, "Second", 1), ("b", 0, 0, "First & best", 0), ("b", 0, 1, "Second", 0), ("b", 1, 0, "First & best", 0), ("b", 1, 1, "Second", 0),
    ]


def test_shorthand_and_toml(tmp_path):
    assert FieldSpec.parse(" a : p.x:y @ href ") == FieldSpec("a", "p.x:y", "href")
    assert FieldSpec.parse("a:@") == FieldSpec("a", "", "text")
    with pytest.raises(ValueError):
        FieldSpec.parse("nothing")
    (tmp_path / "jobs.toml").write_text(
        '[[jobs]]\nname = "A b"\nurl = "https://x/"\nselector = "p"\nfields = ["t:p", {name = "l", selector = "a", att = "href"}]\n'
        'interval = 5\n[jobs.notification]\ntitle = "{job_name}"\n'
    )
    spec = load_specs(tmp_path / "jobs.toml")[0]
    assert (spec.job_id, spec.interval, spec.fields[1], spec.notification.title) == ("a_b", 5, FieldSpec("l", "a", "href"), "{job_name}")


def test_selector_reading():
    assert selectors.read_path("a:hover") is None and selectors.read_path(" ") is None
    assert not selectors.literal_only("a, b") and selectors.literal_only("a > b.c#d")


def test_column_names_stay(spark):
    rows = extract_items(pages(spark, CARDS).withColumn("status", F.lit(200)), JobSpec("J", URL, ".card", ["t:h2"]))
    assert rows.columns == ["page_id", "url", "status", "selector_matches", "item_ord", "fields", "job_id", "matches"]


@pytest.mark.parametrize("read", [lambda rows: page_links(rows), lambda rows: extract_items(rows, JobSpec("All", URL, "p:not(.x)", ["text:b"]))])
def test_every_parse_bounds_the_batches_of_its_session(spark, read):
    names = [f"spark.sql.execution.arrow.max{kind}PerBatch" for kind in ("Records", "Bytes")]
    before = [spark.conf.get(name) for name in names]
    try:
        spark.conf.set(names[0], "10000")
        spark.conf.set(names[1], str(64 << 20))
        read(pages(spark, "<p><a href=x>a</a></p>"))
        assert 0 < int(spark.conf.get(names[0])) <= 256 and 0 < int(spark.conf.get(names[1])) <= 4 << 20
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
