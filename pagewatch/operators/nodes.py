"""Tolerant reading of HTML into a flat node table per page.

Nodes are numbered in document order, and each keeps the number of its last descendant, so "d lies inside a" is
``a.id < d.id <= a.last`` and a subtree is a plain slice of the node array. Text lives in ``segments`` in document
order; each node keeps its range there. Everything later is built-in Spark functions on these two arrays; this module
holds the only per-page Python.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from pagewatch.session import give_back

# Tags that never have content.
VOID_TAGS = frozenset(
    ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
)

# Characters with the Unicode White_Space property.
SPACES = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# A tag runs to the first '>' outside quotes. Possessive repeats keep a failed match linear in the page size.
MARKUP = re.compile(r"""<((?:[^'">]++|'[^']*'|"[^"]*")*+)>""")
NAME = re.compile(f"[^{SPACES}]+")
ATTRIBUTE = re.compile(
    r"""([^ \t\n\f\r=/]+)[ \t\n\f\r]*(?:=[ \t\n\f\r]*(?:"([^"]*)"?|'([^']*)'?|([^ \t\n\f\r/]*)))?"""
)
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Bytes of markup that a worker reads at a time. Nodes take many times the room of their text, so a whole Arrow batch of pages
# is not read at once.
READ_BYTES = 1 << 20

INT, TEXT = T.IntegerType(), T.StringType()
NODE_TYPE = (
    T.StructType()
    .add("id", INT).add("last", INT).add("parent", INT).add("child_no", INT).add("siblings", INT)
    .add("tag", TEXT).add("id_attr", TEXT).add("classes", T.ArrayType(TEXT)).add("attrs", T.MapType(TEXT, TEXT))
    .add("start", INT).add("open_end", INT).add("close_start", INT).add("end", INT)
    .add("seg_from", INT).add("seg_to", INT)
)
DOCUMENT_TYPE = T.StructType().add("nodes", T.ArrayType(NODE_TYPE)).add("segments", T.ArrayType(TEXT))

# Places of the whole-number columns in the list that is kept per node while a page is read.
INT_FIELDS = ["id", "last", "parent", "child_no", "siblings", "start", "open_end", "close_start", "end", "seg_from", "seg_to"]
LAST, PARENT, SIBLINGS, CLOSE_START, END, SEG_TO = (
    INT_FIELDS.index(name) for name in ["last", "parent", "siblings", "close_start", "end", "seg_to"]
)


class Page:
    """Nodes and text segments of one page, filled by one pass over its markup."""

    def __init__(self, html: str) -> None:
        self.rows: list[list[int]] = []
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.segments: list[str] = []
        self._html = html
        self._open: list[int] = []
        self._open_tags: Counter[str] = Counter()
        self._children = [0]
        self._text_at = 0
        self._read()

    def _read(self) -> None:
        html, at = self._html, 0
        while (at := html.find("<", at)) >= 0:
            markup = MARKUP.match(html, at)
            if markup is None:
                break
            start, at = at, markup.end()
            inner = markup[1].strip(SPACES)
            if not inner or inner[0] in "!?":
                continue
            if inner[0] == "/":
                name = NAME.match(inner[1:].lstrip(SPACES))
                self._close(fold(name[0]) if name else "", start, at)
            else:
                self._start(inner, start, at)
        self._ended()

    def _ended(self) -> None:
        end = len(self._html)
        self._flush(end)
        while self._open:
            self._finish(self._open.pop(), end, end)
        for row in self.rows:
            row[SIBLINGS] = self._children[row[PARENT]]

    def _flush(self, end: int) -> None:
        if end > self._text_at and self._open:
            self.segments.append(self._html[self._text_at : end])

    def _start(self, inner: str, start: int, end: int) -> None:
        body = inner.rstrip("/").strip(SPACES)
        name = NAME.match(body)
        if name is None:
            return
        self._flush(start)
        tag = fold(name[0])
        self._node(tag, attributes(body[name.end() :]) if name.end() < len(body) else NO_ATTRIBUTES, start, end, inner[-1] == "/")

    def _node(self, tag: str, attrs: dict[str, str], start: int, end: int, closed: bool) -> None:
        node, parent, at = len(self.tags), self._open[-1] if self._open else -1, len(self.segments)
        # The last place counts the children of the page itself, whose number is -1.
        self._children[parent] += 1
        self.rows.append([node, node, parent, self._children[parent], 0, start, end, end, end, at, at])
        self._children.insert(node, 0)
        self.tags.append(tag)
        self.attrs.append(attrs)
        self._text_at = end
        if not closed and tag not in VOID_TAGS:
            self._open.append(node)
            self._open_tags[tag] += 1

    def _close(self, name: str, start: int, end: int) -> None:
        if not self._open_tags[name]:
            return
        self._flush(start)
        self._text_at = end
        while True:
            node = self._open.pop()
            tag = self.tags[node]
            self._open_tags[tag] -= 1
            self._finish(node, start, end)
            if tag == name:
                return

    def _finish(self, node: int, close_start: int, end: int) -> None:
        row = self.rows[node]
        row[LAST] = len(self.tags) - 1
        row[CLOSE_START] = close_start
        row[END] = end
        row[SEG_TO] = len(self.segments)


NO_ATTRIBUTES: dict[str, str] = {}

# What a start tag ends (first), as far as no tag of the second set is open in between.
ENDED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    **dict.fromkeys(["thead", "tbody", "tfoot"], ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"})),
}
# Start tags that end an open paragraph, tags that end tags do not reach across, parts of a table, and
# elements whose content is text whatever it looks like.
AFTER_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr li dd dt main menu nav ol p pre search section summary table ul".split()
)
SCOPES = frozenset(["table", "td", "th", "caption", "template", "object", "marquee", "applet"])
TABLE_PARTS = frozenset(["tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"])
RAW_TEXT = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE) for tag in ["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"]}


class RepairedPage(Page):
    """The tree that a browser makes of a page: elements whose end tags are left out end where the next one of their kind
    begins, rows of a table stand in a ``tbody`` and cells in a row, end tags do not reach out of a cell, and comments
    and the content of scripts hold no elements. Formatting elements are not opened anew in the next paragraph, and
    ``html``, ``head`` and ``body`` are there only if the page names them.

    Work is linear in the page: for every tag the places of its open elements are kept.
    """

    def __init__(self, html: str) -> None:
        self._places: dict[str, list[int]] = {}
        super().__init__(html)

    def _read(self) -> None:
        html, at = self._html, 0
        while (at := html.find("<", at)) >= 0:
            if html.startswith("<!--", at):
                self._flush(at)
                end = html.find("-->", at + 4)
                self._text_at = at = len(html) if end < 0 else end + 3
                continue
            markup = MARKUP.match(html, at)
            if markup is None:
                break
            start, at = at, markup.end()
            inner = markup[1].strip(SPACES)
            if not inner:
                continue
            if inner[0] in "!?":
                self._flush(start)
                self._text_at = at
            elif inner[0] == "/":
                name = NAME.match(inner[1:].lstrip(SPACES))
                self._close(fold(name[0]) if name else "", start, at)
            else:
                known = len(self.tags)
                self._start(inner, start, at)
                if len(self.tags) > known and self._open and self.tags[self._open[-1]] in RAW_TEXT:
                    close = RAW_TEXT[self.tags[self._open[-1]]].search(html, at)
                    at = close.start() if close else len(html)
        self._ended()

    def _last(self, tags: set[str] | frozenset[str]) -> int:
        """Place among the open elements of the innermost one of ``tags``, -1 without any."""
        return max((places[-1] for tag in tags if (places := self._places.get(tag))), default=-1)

    def _pop(self, start: int, end: int) -> None:
        node = self._open.pop()
        self._places[self.tags[node]].pop()
        self._finish(node, start, end)

    def _pop_to(self, place: int, start: int, end: int) -> None:
        while len(self._open) > place:
            self._pop(start, end if len(self._open) == place + 1 else start)

    def _opened(self, tag: str, attrs: dict[str, str], start: int, end: int, closed: bool) -> None:
        depth = len(self._open)
        super()._node(tag, attrs, start, end, closed)
        if len(self._open) > depth:
            self._places.setdefault(tag, []).append(depth)

    def _node(self, tag: str, attrs: dict[str, str], start: int, end: int, closed: bool) -> None:
        if tag in AFTER_PARAGRAPH and (place := self._last({"p"})) > self._last(SCOPES | {"button"}):
            self._pop_to(place, start, start)
        if tag in ENDED:
            ended, within = ENDED[tag]
            outer = self._last(within)
            while (place := self._last(ended)) > outer:
                self._pop_to(place, start, start)
        top = self.tags[self._open[-1]] if self._open else ""
        if tag in ("tr", "td", "th") and top == "table":
            self._opened("tbody", NO_ATTRIBUTES, start, start, False)
            top = "tbody"
        if tag in ("td", "th") and top in ("tbody", "thead", "tfoot"):
            self._opened("tr", NO_ATTRIBUTES, start, start, False)
        # Of a self-closing mark only elements without content take notice.
        self._opened(tag, attrs, start, end, closed and tag not in RAW_TEXT and tag not in ENDED and tag not in AFTER_PARAGRAPH)

    def _close(self, name: str, start: int, end: int) -> None:
        place = self._last({name})
        if name == "table":
            bound = -1
        elif name in TABLE_PARTS:
            bound = self._last({"table"})
        else:
            bound = self._last((SCOPES | {"ul", "ol"} if name == "li" else SCOPES) - {name})
        self._flush(start)
        self._text_at = end
        if place > bound:
            self._pop_to(place, start, end)
        elif name == "p":  # as browsers do, an end tag alone is an empty paragraph
            self._opened(name, NO_ATTRIBUTES, start, end, True)

    def _ended(self) -> None:
        end = len(self._html)
        self._flush(end)
        while self._open:
            self._pop(end, end)
        super()._ended()


def fold(name: str) -> str:
    return name.lower() if name.isascii() else name.translate(FOLD)


def attributes(text: str) -> dict[str, str]:
    """Attribute names in lower case with their raw values; a repeated name keeps its last value."""
    found = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        found[fold(name.strip(SPACES))] = double or single or bare
    return found


def _offsets(counts: list[int]) -> pa.Array:
    return pa.array(np.cumsum([0, *counts]), pa.int32())


def read_pages(html: pa.Array, reader: type[Page] = Page) -> pa.Array:
    """One Arrow batch of pages to one batch of (nodes, segments), built column by column."""
    pages = [reader(text or "") for text in html.to_pylist()]
    attrs = [a for page in pages for a in page.attrs]
    classes = [NAME.findall(a["class"]) if "class" in a else [] for a in attrs]
    numbers = np.array([row for page in pages for row in page.rows], dtype=np.int32).reshape(-1, len(INT_FIELDS))
    text = pa.string()
    columns = {
        **{name: pa.array(np.ascontiguousarray(numbers[:, at])) for at, name in enumerate(INT_FIELDS)},
        "tag": pa.array([t for page in pages for t in page.tags], text),
        "id_attr": pa.array([a.get("id") for a in attrs], text),
        "classes": pa.ListArray.from_arrays(_offsets([len(c) for c in classes]), pa.array([c for cs in classes for c in cs], text)),
        "attrs": pa.MapArray.from_arrays(
            _offsets([len(a) for a in attrs]),
            pa.array([k for a in attrs for k in a], text),
            pa.array([v for a in attrs for v in a.values()], text),
        ),
    }
    order = NODE_TYPE.fieldNames()
    nodes = pa.StructArray.from_arrays([columns[name] for name in order], names=order)
    node_lists = pa.ListArray.from_arrays(_offsets([len(page.tags) for page in pages]), nodes)
    segment_lists = pa.ListArray.from_arrays(
        _offsets([len(page.segments) for page in pages]), pa.array([s for page in pages for s in page.segments], text)
    )
    return pa.StructArray.from_arrays([node_lists, segment_lists], names=["nodes", "segments"])


def _bytes_of(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(sizes: np.ndarray) -> Iterator[slice]:
    """The rows of a batch in runs of about ``READ_BYTES``; a larger row is a run of its own."""
    start = total = 0
    for at, size in enumerate(sizes.tolist()):
        if at > start and total + size > READ_BYTES:
            yield slice(start, at)
            start, total = at, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def _read_in_runs(batches: Iterator[pa.Array], reader: type[Page]) -> Iterator[pa.Array]:
    for html in batches:
        for run in _runs(_bytes_of(html)):
            yield read_pages(html[run], reader)
    give_back()


@F.arrow_udf(DOCUMENT_TYPE)
def _document(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _read_in_runs(batches, Page)


def document(html: Column) -> Column:
    """``struct<nodes, segments>`` of a page body."""
    return _document(html)


@F.arrow_udf(DOCUMENT_TYPE)
def _repaired(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _read_in_runs(batches, RepairedPage)


def repaired(html: Column) -> Column:
    """``struct<nodes, segments>`` of a page body as a browser's tree; no nodes where the body is NULL."""
    return _repaired(html)


READING_TYPE = T.StructType().add("tree", DOCUMENT_TYPE).add("items", T.ArrayType(T.ArrayType(DOCUMENT_TYPE)))


def _second_bytes(html: pa.Array, items: pa.Array) -> np.ndarray:
    """Bytes of each page and of the texts of its items."""
    lists = pc.list_flatten(items)
    page_of = pc.list_parent_indices(items).to_numpy()[pc.list_parent_indices(lists).to_numpy()]
    return _bytes_of(html) + np.bincount(page_of, _bytes_of(pc.list_flatten(lists)), len(html)).astype(np.int64)


def _read_twice(html: pa.Array, items: pa.Array) -> pa.Array:
    texts = items.to_pylist()
    outer, inner = [len(lists or ()) for lists in texts], [len(ts or ()) for lists in texts for ts in lists or ()]
    flat = pa.array([t for lists in texts for ts in lists or () for t in ts or ()], pa.string())
    lists = pa.ListArray.from_arrays(_offsets(inner), read_pages(flat, RepairedPage))
    return pa.StructArray.from_arrays([read_pages(html, RepairedPage), pa.ListArray.from_arrays(_offsets(outer), lists)], names=["tree", "items"])


@F.arrow_udf(READING_TYPE)
def _second_reading(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for html, items in batches:
        for run in _runs(_second_bytes(html, items)):
            yield _read_twice(html[run], items[run])
    give_back()


def second_reading(html: Column, items: list[Column]) -> Column:
    """``struct<tree, items>``: a page as a browser's tree, and each text of some arrays as a tree of its own; nothing
    where they are NULL. One Python step makes both."""
    return _second_reading(html, F.array(*items) if items else F.array().cast("array<array<string>>"))
