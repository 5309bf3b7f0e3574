"""Main text of web pages by a tree-structured graphical model.

Every element that may hold text is a node with two states, content or not. Its tag, names, text and links speak for a
state, and potentials between parent and child for passing a state down. Sums of products travel from the leaves to the
root and back, which gives every node its marginal under the whole page. Both kinds of potentials are learned, from
pages whose content is marked, by following the gradient of their likelihood, which the same marginals give.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewatch.llm.common import slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?:^|[\s\"'/])(class|id|role|aria-label|data-y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
QUOTED, UNQUOTED, FONT = re.compile(r"\"[^\"]*\"|'[^']*'"), re.compile(r"=\s*[^\s\"']\S*\Z"), re.compile(r"(?:^|[\s\"'/])(?:color|face|size)\s*=", re.I)
WHITE = " \t\n\f\r"
WORD = re.compile(r"[a-z]+|\d+")

# Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("button datalist head iframe noscript object option script select style svg template textarea title".split())
RAW = frozenset("iframe noscript script style template textarea title".split())
#: Tags that may stand in a head.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An opening tag ends an open element of these, unless one of the second list lies between.
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "tr": ("tr", "table"), "option": ("option", "select")}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in IMPLIED.items()}
#: An opening tag that ends an open silent element without its closing tag; and those that end an svg as browsers do,
#: unless they stand in a part of it that holds HTML.
ENDED_BY = {"button": frozenset({"button"}), "option": frozenset({"option", "optgroup"}), "select": frozenset("input keygen select textarea".split())}
LEAVES_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split())
HOLDS_HTML = frozenset("desc foreignobject title".split())

TAGS = ("article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "nav", "header", "footer", "aside", "form fieldset", "table tbody tr td th", "figure figcaption", "blockquote pre", "dialog", "html body")
TAGS = {tag: k for k, group in enumerate(TAGS) for tag in group.split()}
HINTS = (
    "article content main post story entry body text prose",
    "nav navbar navigation menu menus breadcrumb breadcrumbs toc pagination pager",
    "header head masthead topbar logo branding",
    "footer foot copyright legal imprint colophon",
    "sidebar side aside rail widget widgets related recommended more",
    "ad ads advert adverts advertisement advertising promo promotion sponsor sponsored banner",
    "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe gdpr warning paywall",
    "comment comments reply replies discussion disqus respond reader",
    "share sharing social follow tags meta byline",
    "form login signup search register contact",
)
HINTS = {word: k for k, group in enumerate(HINTS) for word in group.split()}
FEATURES = 18 + 10 + 8
#: Tags whose texts read on in what they lie in.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure".split())
#: Tags whose text is set apart from what surrounds it.
APART = frozenset({7, 8, 9, 10, 11, 15})


@dataclass
class Page:
    """Nodes in page order, a parent before its children; and the texts, each with its node and whether a block ended before it."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    marked: list[int] = field(default_factory=list)
    texts: list[tuple[int, bool, str]] = field(default_factory=list)
    in_links: list[int] = field(default_factory=list)


class Open:
    """Open elements, innermost last, and where those of each tag are, so that no lookup walks through all of them."""

    def __init__(self) -> None:
        self.elements: list[tuple] = []  # tag first
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []  # places that the end of a mere markup of words does not reach through

    def push(self, element: tuple, wall: bool) -> None:
        self.places.setdefault(element[0], []).append(len(self.elements))
        if wall:
            self.walls.append(len(self.elements))
        self.elements.append(element)

    def cut(self, k: int) -> list[tuple]:
        """Take away the elements from place ``k`` on, innermost first."""
        gone = []
        while len(self.elements) > k:
            gone.append(self.elements.pop())
            self.places[gone[-1][0]].pop()
            if self.walls and self.walls[-1] == len(self.elements):
                self.walls.pop()
        return gone

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost element with one of these tags; -1 without any."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=-1)

    def ended_by(self, tag: str) -> int:
        """The place of the element that a closing ``tag`` ends; -1 if it ends none."""
        k = self.last((tag,))
        return -1 if tag in INLINE and self.walls and self.walls[-1] > k else k

    def close(self, tags: frozenset, fence: frozenset) -> None:
        """End the innermost element of ``tags`` unless one of ``fence`` lies in it."""
        k = self.last(tags)
        if k >= 0 and k > self.last(fence):
            self.cut(k)


def read_page(source: str) -> Page:
    """The nodes of a page: elements that are no mere markup of words, or that have a name. Open ends are closed as
    browsers do for paragraphs, items and cells; what the page never shows as text is left out, up to where it ends."""
    page = Page([-1], ["body"], [""], [0], [], [0])
    stack = Open()  # tag, node, inside a link
    broken, at, unclosed, endless = False, 0, set(), set()

    def here() -> tuple[int, bool]:
        return stack.elements[-1][1:] if stack.elements else (0, False)

    def say(text: str) -> None:
        nonlocal broken
        if text:
            node, link = here()
            page.texts.append((node, broken, html.unescape(text)))
            if link:
                page.in_links[node] += len(text)
            broken = False

    while m := TOKEN.search(source, at):
        say(source[at : m.start()])
        at = m.end()
        closing, tag, rest = tag_of(m)
        if tag is None:
            continue
        inline = tag in INLINE
        broken = broken or not inline
        if closing:
            k = stack.ended_by(tag)
            if k >= 0:
                stack.cut(k)
            continue
        if tag in VOID:
            continue
        if tag in ENDS_PARAGRAPH:
            stack.close(frozenset({"p"}), frozenset({"article", "aside", "blockquote", "div", "li", "main", "section", "table", "td", "body"}))
        if tag in IMPLIED:
            stack.close(*IMPLIED[tag])
        if tag in SILENT:
            if tag not in RAW:
                at = silent_end(source, at, tag, rest, stack, unclosed)
            elif not is_empty(rest) or tag not in endless:
                end = raw_end(source, at, tag)
                if end == len(source):
                    endless.add(tag)
                at = at if is_empty(rest) and end == len(source) else end
            continue
        found = NAMES.findall(rest) if rest else []
        names = " ".join((b or c or d) for a, b, c, d in found if a.lower() != "data-y").lower()
        mark = next((int((b or c or d) == "1") for a, b, c, d in found if a.lower() == "data-y"), None)
        up, within = here()
        link = tag == "a" or (inline and within)
        if inline and not names:
            stack.push((tag, up, link), False)
            continue
        if tag in ("html", "body"):
            page.names[0] = names or page.names[0]
            page.marked[0] = mark or page.marked[0]
            continue
        node = len(page.parent)
        page.parent.append(up)
        page.tag.append(tag)
        page.names.append(names)
        page.marked.append(page.marked[up] if mark is None else mark)
        page.in_links.append(0)
        stack.push((tag, node, link), not inline)
    say(source[at:])
    return page


def tag_of(m: re.Match) -> tuple[str, str | None, str]:
    """Whether it closes, the tag in lower case (None for comments and the like), and what follows the tag."""
    closing, tag, rest = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
    return closing, tag and tag.lower(), rest


def is_empty(rest: str) -> bool:
    """Whether a tag ends in a slash that is not the end of an unquoted value."""
    return rest.endswith("/") and not UNQUOTED.search(QUOTED.sub('""', rest))


def silent_end(source: str, at: int, tag: str, rest: str, stack: Open, unclosed: set[int]) -> int:
    """Where reading goes on after an element without shown text, whose opening tag ends at ``at``.

    It ends behind its closing tag. Where something else ends it (the closing of an element of ``stack``, a tag or text
    that cannot stand in it, the end of the page), its author has not closed it, and it reaches only to the first block
    in it, so that it never hides what follows. ``unclosed`` keeps such elements by place, so that what lies in one is
    not searched again for the end of each.
    """
    if tag == "svg" and is_empty(rest):
        return at
    known = at in unclosed or (tag != "head" and is_empty(rest))
    inside = Open()  # tag, place, whether HTML stands in it
    inside.push((tag, at, tag != "svg"), tag != "svg" and tag not in INLINE)
    stop = None  # where it ends if it is not closed

    def drop(k: int) -> None:
        unclosed.update(place for _, place, _ in inside.cut(k))

    while m := TOKEN.search(source, at):
        if tag == "head" and source[at : m.start()].strip(WHITE):
            return at
        at = m.end()
        closing, name, rest = tag_of(m)
        if name is None:
            continue
        if closing:
            k = inside.ended_by(name)
            if k >= 0:
                drop(k + 1)
                inside.cut(k)
                if not inside.elements:
                    return at
            elif name in ("body", "html") or stack.ended_by(name) >= 0:
                stop = m.start() if stop is None else stop
                if known or tag == "svg" or name not in INLINE:
                    break
            continue
        in_html = inside.elements[-1][2]
        if tag == "head":
            if name not in IN_HEAD:
                return m.start()
            if name in RAW and not is_empty(rest) or name == "noframes":
                at = raw_end(source, at, name)
            continue
        if stop is None and in_html == (tag != "svg") and (name in ENDS_PARAGRAPH or name in IMPLIED and name != "option"):
            stop = m.start()
            if known:
                break
        if in_html and name in ENDED_BY.get(tag, ()):
            stop = m.start() if stop is None else stop
            break
        if not in_html and (name in LEAVES_SVG or name == "font" and FONT.search(rest)):
            while inside.elements and not inside.elements[-1][2]:
                inside.cut(len(inside.elements) - 1)
            if not inside.elements:
                return m.start() if stop is None else stop
            in_html = True
        if in_html and name in RAW and not is_empty(rest):
            at = raw_end(source, at, name)
        elif name not in VOID and not ((not in_html or name == "svg") and is_empty(rest)):
            html_inside = name in HOLDS_HTML or in_html and name != "svg"
            inside.push((name, at, html_inside), html_inside and name not in INLINE)
    else:
        if tag == "head":
            return at if source[at:].strip(WHITE) else len(source)
        stop = len(source) if stop is None else stop
    drop(1)
    return stop


def raw_end(source: str, at: int, tag: str) -> int:
    """Where an element ends whose text is no markup."""
    m = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
    return m.end() if m else len(source)


def describe(page: Page) -> tuple[np.ndarray, list[int]]:
    """Features of the nodes, and the kind of the edge above each: 1 where the node stands apart by tag or name."""
    n = len(page.parent)
    own, stops = [0] * n, [0] * n
    for node, _, text in page.texts:
        own[node] += len(text)
        stops[node] += text.count(". ") + text.count("? ") + text.count("! ") + text.rstrip().endswith((".", "!", "?"))
    below, links = list(own), list(page.in_links)
    for k in range(n - 1, 0, -1):
        below[page.parent[k]] += below[k]
        links[page.parent[k]] += links[k]
    x, kinds = np.zeros((n, FEATURES)), [0] * n
    for k in range(n):
        group = TAGS.get(page.tag[k], 17)
        x[k, group] = 1
        hints = {HINTS[w] for w in WORD.findall(page.names[k]) if w in HINTS} if page.names[k] else ()
        for h in hints:
            x[k, 18 + h] = 1
        kinds[k] = int(group in APART or any(h > 0 for h in hints))
        x[k, 28] = 1
        x[k, 29] = min(1.0, own[k] / 200)
        x[k, 30] = own[k] > 0
        x[k, 31] = min(1.0, stops[k] / 4)
        x[k, 32] = links[k] / below[k] if below[k] else 0
        x[k, 33] = below[k] / below[0] if k and below[0] else 0
        x[k, 34] = not below[k]
        x[k, 35] = own[k] > 0 and links[k] * 2 > below[k]
    return x, kinds


def is_bare(page: Page) -> bool:
    """Whether running text straight under the body is more than half of the page's text."""
    straight = [not up and tag in RUNNING for up, tag in zip(page.parent, page.tag)]
    straight[0] = True
    for k in range(1, len(straight)):
        straight[k] = straight[k] or (page.parent[k] > 0 and straight[page.parent[k]])
    return 2 * sum(len(text.strip()) for node, _, text in page.texts if straight[node]) > sum(len(text.strip()) for _, _, text in page.texts)


@dataclass
class Model:
    """``unary`` speaks for content; ``pair[kind, parent, child]`` are the potentials of edges. ``bare`` is the model of
    pages that have their content straight under the body, where being the root speaks for content, not against it."""

    unary: np.ndarray
    pair: np.ndarray
    bare: Model | None = None

    def pass_messages(self, parent: list[int], kinds: list[int], odds: list[float]) -> tuple[list[float], list[float], list[float]]:
        """Log odds of every node under the whole tree; of it and what hangs below it; and of its parent without it."""
        n = len(parent)
        tables = [[math.exp(v) for v in t] for t in self.pair.reshape(len(self.pair), 4).tolist()]
        below, up = list(odds), [0.0] * n
        for k in range(n - 1, 0, -1):
            p00, p01, p10, p11 = tables[kinds[k]]
            e = math.exp(min(max(below[k], -30.0), 30.0))
            up[k] = math.log((p10 + p11 * e) / (p00 + p01 * e))
            below[parent[k]] += up[k]
        whole, outside = list(below), [0.0] * n
        for k in range(1, n):
            p00, p01, p10, p11 = tables[kinds[k]]
            outside[k] = whole[parent[k]] - up[k]
            e = math.exp(min(max(outside[k], -30.0), 30.0))
            whole[k] = below[k] + math.log((p01 + p11 * e) / (p00 + p10 * e))
        return whole, below, outside

    def marginals(self, page: Page) -> list[float]:
        if self.bare and is_bare(page):
            return self.bare.marginals(page)
        x, kinds = describe(page)
        whole, _, _ = self.pass_messages(page.parent, kinds, (x @ self.unary).tolist())
        return [1 / (1 + math.exp(-min(max(v, -30.0), 30.0))) for v in whole]


def learn(pages: list[Page], steps: int = 80, rate: float = 0.15) -> Model:
    """Potentials under which the marks of ``pages`` are likeliest, with a little decay."""
    seen = [(page, *describe(page), np.array(page.marked, float)) for page in pages]
    model = Model(np.zeros(FEATURES), np.zeros((2, 2, 2)))
    first, second = np.zeros(FEATURES + 8), np.zeros(FEATURES + 8)
    nodes = sum(len(p.parent) for p in pages)
    for step in range(1, steps + 1):
        unary, pair = np.zeros(FEATURES), np.zeros((2, 2, 2))
        for page, x, kinds, y in seen:
            whole, below, outside = model.pass_messages(page.parent, kinds, (x @ model.unary).tolist())
            unary += x.T @ (y - 1 / (1 + np.exp(-np.clip(whole, -30, 30))))
            for k in range(1, len(y)):
                t = model.pair[kinds[k]] + np.array([[0, below[k]], [outside[k], outside[k] + below[k]]])
                t = np.exp(t - t.max())
                pair[kinds[k]] -= t / t.sum()
                pair[kinds[k], page.marked[page.parent[k]], page.marked[k]] += 1
        g = np.concatenate([unary, pair.reshape(-1)]) / nodes - 2e-4 * np.concatenate([model.unary, model.pair.reshape(-1)])
        first, second = 0.9 * first + 0.1 * g, 0.98 * second + 0.02 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.98**step)) + 1e-8)
        model.unary, model.pair = model.unary + move[:FEATURES], model.pair + move[FEATURES:].reshape(2, 2, 2)
    return model


def labelled_pages(number: int = 160, seed: int = 11, bare: bool = False) -> list[str]:
    """Pages of common layouts whose content is marked by ``data-y``, made of drawn words: what the model learns from.
    ``bare`` pages have it straight under the body."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ba", "ro", "ti", "en", "sol", "ka", "mu", "ver")) for _ in range(rng.randrange(1, 4)))
    line = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b)))
    text = lambda: " ".join(line(1, 18).capitalize() + "." for _ in range(rng.choice([1, 2, 3, 5, 8, 25])))
    links = lambda a, b: "".join(f'<li><a href="#">{line(1, 3)}</a></li>' for _ in range(rng.randrange(a, b)))

    def content() -> str:
        out = [f"<h1>{line(3, 9)}</h1>"] if rng.random() < 0.8 else []
        if rng.random() < 0.3:  # an article may be a line or two
            return "".join(out) + rng.choice(["<p>{}</p>", "<p><b>{}<br>", "<p>{}"]).format(rng.choice([line(1, 6) + ".", line(4, 12) + ".", text()]))
        for _ in range(rng.randrange(1, 8)):
            out.append(rng.choice([f"<p>{text()}</p>"] * 6 + [f"<p><b>{text()}<br>", f"<p>{line(1, 4)}.</p>", f'<p>{text()} <a href="#">{line(1, 4)}</a>.</p>', f"<h2>{line(2, 6)}</h2>", f"<ul><li>{text()}<li>{line(2, 9)}</ul>", f"<blockquote>{text()}</blockquote>", f"<div>{text()}</div>", f"<table><tr><td>{line(1, 4)}<td>{line(1, 3)}</table>"]))
            if rng.random() < 0.12:
                out.append(f'<div class="{rng.choice(["ad", "ad-slot", "advert", "promo", "newsletter", "share"])}" data-y="0">{text()}</div>')
        return "".join(out)

    def extras(names: list[str], tags: list[str], body) -> str:
        name = rng.choice([*names, ""]) if len(tags) > 1 else rng.choice(names)
        tag = rng.choice(tags) if name else tags[-1]
        return f'<{tag} class="{name}" data-y="0">{body()}</{tag}>' if name else f'<{tag} data-y="0">{body()}</{tag}>'

    out = []
    for _ in range(number):
        before = [
            lambda: extras(["nav", "menu", "navbar"], ["div", "ul", "nav"], lambda: f"<ul>{links(2, 9)}</ul>"),
            lambda: extras(["header", "masthead", "top-bar"], ["div", "header"], lambda: rng.choice([line(1, 5), f"<h1>{line(1, 4)}</h1>", text()])),
            lambda: extras(["ad", "ads", "banner", "sponsored"], ["div"], lambda: rng.choice([text(), f"<p>{text()}</p>"])),
            lambda: extras(["cookie-notice", "notice", "alert", "consent"], ["div"], lambda: f"<p>{text()}</p><button>{word()}</button>"),
            lambda: extras(["search", "login"], ["div", "form"], lambda: f"<label>{line(1, 4)}</label><input><p>{line(2, 7)}</p>"),
            lambda: extras(["breadcrumb"], ["div"], lambda: f'<a href="#">{word()}</a> / <a href="#">{word()}</a>'),
        ]
        after = [
            lambda: extras(["sidebar", "side", "related"], ["div", "aside"], lambda: f"<h3>{line(1, 4)}</h3><p>{text()}</p><ul>{links(1, 6)}</ul>"),
            lambda: extras(["footer", "copyright"], ["div", "footer"], lambda: rng.choice([f"&copy; {line(2, 12)}.", f"<p>{text()}</p>"])),
            lambda: extras(["comments", "comment-list"], ["div", "section"][:1], lambda: "".join(f'<div class="comment"><p>{text()}</p></div>' for _ in range(rng.randrange(1, 5)))),
            lambda: extras(["newsletter", "subscribe"], ["div", "form"], lambda: f"<p>{text()}</p><input>"),
            lambda: extras(["share", "tags"], ["div"], lambda: f"<ul>{links(1, 5)}</ul>"),
            before[2],
        ]
        inner = content()
        kind = rng.randrange(6)
        if bare:
            body = f"{inner}<p>{text()}</p>"
        elif kind < 2:
            body = f'<article data-y="1">{inner}</article>'
        elif kind == 2:
            body = f'<main data-y="1">{inner}</main>'
        elif kind == 3:
            body = f'<div class="{rng.choice(["content", "post-body", "article-text", "main", "entry"])}" data-y="1">{inner}</div>'
        elif kind == 4:
            body = f'<div data-y="1">{inner}</div>'
        else:
            body = f'<main data-y="1"><article>{inner}</article></main>'
        pick = lambda parts: "".join(p() for p in rng.sample(parts, rng.randrange(0, len(parts) + 1)))
        body = pick(before) + body + pick(after)
        out.append(f"<!DOCTYPE html><html><head><title>{line(2, 6)}</title></head><body data-y={bare:d}>{f'<div class={chr(34)}wrapper{chr(34)}>{body}</div>' if rng.random() < 0.4 and not bare else body}</body></html>")
    return out


@functools.cache
def trained() -> Model:
    """The models of ``labelled_pages``, learned once a process."""
    model = learn([read_page(source) for source in labelled_pages()])
    model.bare = learn([read_page(source) for source in labelled_pages(80, bare=True)])
    return model


def main_text(source: str | None, model: Model, least: float = 0.5) -> str:
    """The texts of content nodes in page order; white space within a block is one space, and so is a block's end."""
    if not source:
        return ""
    page = read_page(source)
    if not page.texts:
        return ""
    kept = model.marginals(page)
    return " ".join("".join((" " if broken else "") + text for node, broken, text in joined(page, kept, least)).split())


def joined(page: Page, kept: list[float], least: float) -> Iterator[tuple[int, bool, str]]:
    """Texts of content nodes; a block that ended within what is left out still parts its neighbours."""
    broken = False
    for node, ended, text in page.texts:
        broken = broken or ended
        if kept[node] >= least:
            yield node, broken, text
            broken = False


def extract(df: DataFrame, model: Model | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of ``df``: the main text of the whole page, and its code points.

    A null or empty page, and one without content, has the empty text. Repeated rows and null ids or urls are read like
    any other row. Other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [main_text(source, shared.value) for source in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    read = df.select(F.col(id_column).alias("id"), F.col(url_column).alias("url"), F.col(html_column).cast("string").alias("html"))
    kinds = dict(read.dtypes)
    return read.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long").withColumnsRenamed({"id": id_column, "url": url_column})
