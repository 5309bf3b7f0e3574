from __future__ import annotations

import time

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from pagewatch.operators import nodes
from pagewatch.operators.nodes import Page, RepairedPage, attributes

VOID = {"br", "img"}


def tree_text(page: Page, node: int) -> str:
    row = page.rows[node]
    return " ".join(" ".join(page.segments[row[9]:row[10]]).split())


def named(html: str) -> list[tuple[str, str]]:
    page = Page(html)
    return [(tag, tree_text(page, at)) for at, tag in enumerate(page.tags)]


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<a title='x > y'>in</a>", [("a", "in")]),
        ('<script>if (x) { y = "</script>"; }</script>', [("script", 'if (x) { y = "')]),
        ("<p>one <!-- not a node --> two</p>", [("p", "one <!-- not a node --> two")]),
        ("<div><p><b>deep</div>after", [("div", "deep"), ("p", "deep"), ("b", "deep")]),
        ("<ul><li>open<li>end", [("ul", "open end"), ("li", "open end"), ("li", "end")]),
        ("<p>text<unfinished attr='", [("p", "text<unfinished attr='")]),
        ("<p>a</i>b</p>", [("p", "a</i>b")]),
        ("<IMG src=x>t<Br/><p/>u", [("img", ""), ("br", ""), ("p", "")]),
        ("<!doctype html><?xml?><P>x</P >", [("p", "x")]),
        ("<>< ><p>x</p>", [("p", "x")]),
        ("", []),
    ],
)
def test_small_pages(html, expected):
    assert named(html) == expected


def test_attributes():
    assert attributes(" HREF='a b' id=\"q\" bare=x/y flag class=") == {
        "href": "a b", "id": "q", "bare": "x", "y": "", "flag": "", "class": "",
    }
    assert attributes(" a=1 A=2") == {"a": "2"}


def test_offsets_and_ranges():
    html = "<div>é<p>x</p></div>"
    page = Page(html)
    div, p = page.rows
    assert html[p[5]:p[8]] == "<p>x</p>"
    assert (div[0], div[1], p[2], p[3], p[4]) == (0, 1, 0, 1, 1)


pieces = st.lists(st.sampled_from(["<a>", "<b>", "</a>", "</b>", "<br>", "x", " y ", "<!-- c -->"]), max_size=30)


@settings(max_examples=300, deadline=None)
@given(pieces)
def test_nesting_against_a_plain_stack(parts):
    """Ranges must agree with ancestors kept the slow way."""
    page = Page("".join(parts))
    stack: list[int] = []
    inside: dict[int, set[int]] = {}
    at = 0
    for part in parts:
        if part in ("<a>", "<b>", "<br>"):
            for above in stack:
                inside[above].add(at)
            inside[at] = set()
            if part != "<br>":
                stack.append(at)
            at += 1
        elif part.startswith("</"):
            names = [page.tags[node] for node in stack]
            if part[2] in names:
                while page.tags[stack.pop()] != part[2]:
                    pass
    assert len(page.tags) == at
    for node, row in enumerate(page.rows):
        assert set(range(row[0] + 1, row[1] + 1)) == inside[node]


def test_many_unclosed_tags_stay_linear():
    page = Page("<p>" * 50_000 + "</div>" * 50_000)
    assert len(page.tags) == 50_000


@pytest.mark.parametrize(("html", "expected"), [
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "ul(li(ul(li)) li)"), ("<table><tr><td>a<td>b<tr><th>c<tfoot><tr><td></table><b>", "table(tbody(tr(td td) tr(th)) tfoot(tr(td))) b"),
    ("<table><td>x<table><tr><td>y</table>z<td>w</table>", "table(tbody(tr(td(table(tbody(tr(td)))) td)))"), ("<p>a<div>b</p></div>", "p div(p)"), ("<p><b>a<p>b", "p(b) p"),
    ("<div><table><tr><td></div><i></table></div><u>", "div(table(tbody(tr(td(i))))) u"), ("<dl><dt>a<dd>b<dl><dt>c</dl><dt>d</dl>", "dl(dt dd(dl(dt)) dt)"),
    ("<select><option>1<optgroup><option>2<option>3</select>", "select(option optgroup(option option))"), ("<!-- <b> --><script>'<i>'</SCRIPT ><u>", "script u"), ("<li/>x<br/></br><p/>y", "li(br p)"), ("<td><tr>", "td tr"),
])
def test_repaired_trees(html, expected):
    page = RepairedPage(html)

    def shown(parent):
        below = [at for at, row in enumerate(page.rows) if row[2] == parent]
        return " ".join(page.tags[at] + (f"({inner})" if (inner := shown(at)) else "") for at in below)

    assert shown(-1) == expected
    for at, row in enumerate(page.rows):
        own = [k for k, other in enumerate(page.rows) if other[2] == row[2]]
        assert row[0] == at and row[3] == own.index(at) + 1 and row[4] == len(own) and row[5] <= row[6] and row[7] <= row[8] and row[9] <= row[10]


@pytest.mark.parametrize("part", ["<div>", "</p>", "<li>", "<p><b>", "<table><td>", "<div></section>", "<td><tr>", "<ul><li>", "<!-- x -->", "<script>x</script>", "</b><i>"])
def test_repair_is_linear(part):
    began = time.perf_counter()
    RepairedPage(part * (400_000 // len(part)))
    assert time.perf_counter() - began < 4


def test_a_batch_of_pages_is_read_in_bounded_runs(monkeypatch):
    monkeypatch.setattr(nodes, "READ_BYTES", 1000)
    texts = ["<p class=a>" + "x" * n + "</p>" for n in (300, 400, 500, 5000, 1, 2)] + [None]
    html = pa.array(texts, pa.string())
    for udf, reader in ((nodes._document, nodes.Page), (nodes._repaired, nodes.RepairedPage)):
        runs = list(udf.func(iter([html])))
        assert [len(run) for run in runs] == [2, 1, 1, 3]
        assert pa.concat_arrays(runs).to_pylist() == nodes.read_pages(html, reader).to_pylist()
    items = pa.array([[["<b>" + "y" * 600, None], []], [], None, [None, ["<i>z"]], [["<u>" + "w" * 700]], [], [["<b>"]]], pa.list_(pa.list_(pa.string())))
    runs = list(nodes._second_reading.func(iter([(html, items)])))
    assert [len(run) for run in runs] == [1, 2, 1, 3]
    assert pa.concat_arrays(runs).to_pylist() == nodes._read_twice(html, items).to_pylist()


def test_pages_reach_a_worker_in_short_batches(spark, tmp_path):
    import pyarrow as pa

    from pagewatch.sources.pages import scan_pages

    spark.createDataFrame([(i, "x" * 200_000) for i in range(60)], "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    names = [f"spark.sql.execution.arrow.max{kind}PerBatch" for kind in ("Records", "Bytes")]
    before = [spark.conf.get(name) for name in names]
    try:
        spark.conf.set(names[0], "10000")
        pages = scan_pages(spark, str(tmp_path)).coalesce(1)

        def sizes(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

        taken = [r["n"] for r in pages.mapInArrow(sizes, "n long").collect()]
        assert sum(taken) > 60 * 200_000 and max(taken) < 5 << 20
        assert 0 < int(spark.conf.get(names[0])) <= 256
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
