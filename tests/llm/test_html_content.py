from __future__ import annotations

import itertools
import math
import random
import time

import numpy as np
import pytest

from pagewatch.llm.html_content import FEATURES, Model, Page, extract, labelled_pages, main_text, read_page, trained


@pytest.fixture(scope="module")
def model():
    return trained()


PAGES = [
    ('<body><nav><a href="/">Home</a></nav><article><h1>A title</h1><p>First &amp; second.<p>Third &lt;b&gt;  line.\n</article><footer>&copy; Us</footer>', "A title First & second. Third <b> line."),
    ('<div class="menu"><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div><div id="content"><p>Some<b>thing</b> here, it is long enough.</p><script>var a="</p>";</script><p>More.</p></div><div class="comments"><div class="comment"><p>Nice one. I like it.</p></div></div>', "Something here, it is long enough. More."),
    ('<main><p>Only text. And more of it.</p><!-- <p>not this</p> --><form><p>Your name</p><input></form></main><aside><h3>Also</h3><p>Other things. Many.</p></aside>', "Only text. And more of it."),
    ("<style>p{}</style><article><p>Cut &amp", "Cut &"),
    ("<body><h1>Recipe</h1><p>Mix the flour. Add water and salt. Knead it well.</p><p>Serve warm.</p><footer>&copy; 2020 Us</footer>", "Recipe Mix the flour. Add water and salt. Knead it well. Serve warm."),
    ("<body><nav><a href=x>Home</a> <a href=y>News</a></nav><h1>Recipe</h1><p>Mix the flour. Add water and salt.</p><p>Serve warm.</p>", "Recipe Mix the flour. Add water and salt. Serve warm."),
    ("<body><div><div><div><h1>T</h1><p>One line here. Another line there.</p><p>And a third one.</p></div></div></div><footer><p>Contact us. Or not.</p></footer>", "T One line here. Another line there. And a third one."),
    ("", ""),
    ("<div class='cookie-notice'><p>We use cookies. Do you agree?</p></div>", ""),
]


@pytest.mark.parametrize("source, wanted", PAGES)
def test_pages(model, source, wanted):
    assert main_text(source, model) == wanted


def test_marginals_are_sums_over_all_states():
    rng = random.Random(6)
    for _ in range(20):
        n = rng.randrange(1, 8)
        parent = [-1] + [rng.randrange(k) for k in range(1, n)]
        kinds, odds = [rng.randrange(2) for _ in range(n)], [rng.uniform(-2, 2) for _ in range(n)]
        model = Model(np.zeros(FEATURES), np.array([[[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)] for _ in range(2)]))
        total, on = 0.0, [0.0] * n
        for states in itertools.product((0, 1), repeat=n):
            weight = math.exp(sum(o * s for o, s in zip(odds, states)) + sum(model.pair[kinds[k], states[parent[k]], states[k]] for k in range(1, n)))
            total += weight
            on = [a + weight * s for a, s in zip(on, states)]
        whole, _, _ = model.pass_messages(parent, kinds, odds)
        assert [1 / (1 + math.exp(-v)) for v in whole] == pytest.approx([a / total for a in on])


def test_fresh_labelled_pages(model):
    right = total = 0
    for source in labelled_pages(60, seed=500):
        page = read_page(source)
        marginals = model.marginals(page)
        total += len(page.texts)
        right += sum((marginals[node] >= 0.5) == page.marked[node] for node, _, _ in page.texts)
    assert right / total > 0.97


def test_broken_markup_ends():
    for source in ["<", "<p", "<a href='", "</", "<!--", "<script>", "<p></b></i><p", "<" * 2000, "<div>" * 5000, "<p a='" + "x" * 9000, "&#xFFFFFFF; &#0; &", "<head><p>x"]:
        assert isinstance(read_page(source), Page)


@pytest.mark.parametrize("part", ["<div>;</section>", "<select>;</b>", "<p><li>;<b>;<h2></h2>", "<select>;<b>;</i>", ";<script/>", "<i><div>;<b>;</i>"])
def test_reading_is_linear(part):
    """Eight times the markup takes about eight times as long, not sixty-four: unmatched tags walk through no open elements."""

    def seconds(n: int) -> float:
        began = time.process_time()
        read_page("".join(x * n for x in part.split(";")))
        return time.process_time() - began

    seconds(100)
    small, large = min(seconds(4000) for _ in range(3)), seconds(32000)
    assert large < 24 * small + 0.2


#: Parts that show no text, each without its closing tag or in a form that has none; the article after them is shown.
BEFORE = [
    "<head><title>t</title>",
    "<html><head><meta charset=utf-8><link rel=x><script src='a.js'></script>\n",
    "<head><script src='a.js'/>",
    "<svg viewBox='0 0 1 1'/>",
    "<svg class=a /><svg/>",
    "<div><svg><path d='M0'/></div>",
    "<svg><svg></svg><path d='M0'><title>Icon</title></svg>",
    "<div><button>Menu</div>",
    "<div><object data=x><param name=y></div>",
    "<div><button><div>Menu</div></button></div>",
    "<div><button><b><div>Menu</b></div></button></div>",
    "<a href=x><button>Menu</a>",
    "<button>Menu",
    "<button>One<button>Two</button>",
    "<object data=x />",
    "<select><option>One<option>Two</select>",
    "<ul><li><select><option>One<option>Two</ul>",
    "<select><option>One<input>",
    "<svg><path d='M0'>",
    "<svg><foreignObject><div>Label</div></foreignObject></svg>",
]


@pytest.mark.parametrize("before", BEFORE)
def test_silent_elements_end(model, before):
    article = "<article><h1>A title</h1><p>First line. Second line.</p></article>"
    wanted = "A title First line. Second line."
    assert " ".join("".join(" " * broken + text for _, broken, text in read_page(before + article).texts).split()) == wanted
    assert main_text(before + article, model) == wanted
    assert main_text(f"<body>{before}{article}</body></html>", model) == (wanted if not before.startswith(("<head", "<html")) else main_text(article, model))


def test_texts_of_odd_pages():
    shown = lambda source: " ".join("".join(" " * broken + text for _, broken, text in read_page(source).texts).split())
    assert shown("<head><p>x") == "x" and shown("<head><title>t</title>x") == "x" and shown("<head> <style>p{}</style> <body>x") == "x"
    assert shown("<div><button>a<article>b</article></div>c") == "b c"
    assert shown("<svg class=a/>a</svg>b") == "b"  # the slash is a part of the value
    assert shown("<button>a</button>b<object><object>c</object>d</object>e") == "b e"
    assert shown("<script>if (a<b && c == ') x</script><p>it's</p><p>here") == "it's here"
    assert shown("<svg><text>a</text><p>b") == "b"
    assert shown("<object><p>" * 3000 + "x") == "x"


def test_rows(spark, model):
    rows = [(i, f"u{i}", s, "x") for i, (s, _) in enumerate(PAGES)] + [(None, None, None, "x"), (0, "u0", PAGES[0][0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id if r.page_id is not None else -1, r.text, r.n_chars) for r in extract(df, model).collect()))
    assert got == sorted([(i, w, len(w)) for i, (_, w) in enumerate(PAGES)] + [(-1, "", 0), (0, PAGES[0][1], len(PAGES[0][1]))])
    assert extract(df.limit(0), model).collect() == []
