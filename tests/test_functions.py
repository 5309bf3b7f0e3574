from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from pagewatch.functions import addresses, text, urls
from pagewatch.functions.hashing import content_hash
from pagewatch.functions.matching import keyword_matches
from pagewatch.sources.pages import flatten_headers
from pagewatch.spec import shorthand


def check(spark, cases, function, kind="string"):
    width = len(cases[0]) - 1
    names = [f"c{i}" for i in range(width)]
    rows = spark.createDataFrame(cases, ", ".join(f"{n} string" for n in names) + f", want {kind}")
    got = rows.withColumn("got", function(*[F.col(n) for n in names]))
    assert [tuple(r) for r in got.where("NOT got <=> want").collect()] == []


def test_entities(spark):
    check(spark, [
        ("a&#65;b&#x42;c", "aAbBc"), ("&amp;lt;", "<"), ("&copy;x", "&copy;x"), ("&#65 &#66;", "&#65 &#66;"), ("&#38;#65;", "A"),
        ("&&#35;65;z", "Az"), ("x&#xZZ;&#65;", "x&#xZZ;&#65;"), ("&#65;&#;&#66;", "A&#;&#66;"), ("&#128512;!", "😀!"),
        ("&#55296;", "&#55296;"), ("&#1114112;", "&#1114112;"), ("a&nbsp;b", "a b"), ("&#39;&#039;&apos;", "'''"), ("&#", "&#"),
        ("&#+65;", "A"), ("&#00000000000065;", "A"), ("&#99999999999;", "&#99999999999;"), ("no", "no"), ("", ""),
        ("&#38;#38;#66;", "B"), (";&#59;", ";;"),
    ], text.decode_entities)


def test_urls(spark):
    check(spark, [
        ("http://h/a/b?x=1", "c", "http://h/a/c"), ("http://h/a/b", "../c", "http://h/c"), ("http://h/a/b", "../../../c/./d//e", "http://h/c/d/e"),
        ("http://h", "c", "http://h/c"), ("http://h/a/", "/z/../y", "http://h/z/../y"), ("https://h/a", "//q/w", "https://q/w"),
        ("nobase", "c", "c"), ("http://h/a", "#x", "#x"), ("http://h/a", " mailto:x ", "mailto:x"), ("http://h?q=/x/y", "c", "http://h?q=/x/c"),
        ("http://h/a", "HTTP://x", "http://h/HTTP:/x"), ("http://h/a", "", ""), ("http://h/a", "javascript:f()", "javascript:f()"),
    ], urls.resolve)


def test_addresses(spark):
    check(spark, [
        ("10.0.0.1", True), ("8.8.8.8", False), ("100.63.255.255", False), ("100.64.0.0", True), ("192.0.0.8", True), ("198.18.0.1", True),
        ("198.20.0.0", False), ("240.0.0.1", True), ("256.1.1.1", None), ("01.2.3.4", None), ("::1", True), ("::", True),
        ("::ffff:10.0.0.1", True), ("::ffff:8.8.8.8", False), ("2002:0a00:0001::", True), ("2002:0808:0808::", False),
        ("64:ff9b::8.8.8.8", False), ("64:ff9b::7f00:1", True), ("64:ff9b:1::1", True), ("2606:4700::1111", False), ("fe80::1", True),
        ("fd00::1", True), ("2001:db8::1", True), ("2001:4860:4860::8888", False), ("1:2:3", None), ("1::2::3", None), ("3fff:0fff::1", True),
        ("3fff:1000::1", False), ("172.31.255.255", True), ("172.32.0.0", False), ("2001:20::1", True), ("FF02::1", True),
        ("1:2:3:4:5:6:7:8", False), ("12345::", None), ("100::1", True), ("::ffff:0:8.8.8.8", False),
    ], addresses.is_forbidden, "boolean")


def test_query_strings(spark):
    check(spark, [("a+b%20c", "a b c"), ("%zz", "%zz"), ("%%41", "%%41"), ("%e9", ""), ("%C3%A9", "é"), ("%4", "%4"), ("+%2B", " +"), ("%+g+", "%+g ")],
          text.url_decode)


def test_names(spark):
    check(spark, [("  Ünï co-de 9! ", "ünï_co_de_9"), ("__A__", "a"), ("Ⅷ x", "ⅷ_x")], text.job_id)
    check(spark, [("first_nAME", "First NAME"), ("_x", " X"), ("éa", "Éa"), ("", "")], text.label)
    check(spark, [
        ("Blocked private network address", "blocked"), ("http status: 500 timeout", "http"), ("could not RESOLVE", "dns"), ("x timed out", "timeout"),
        ("bad Certificate", "tls"), ("proxy", "proxy"), ("connection", "connect"), ("exceeds", "size"), ("?", "unknown"),
    ], text.failure_kind)


def test_numbers_as_text(spark):
    row = spark.range(1).select(
        text.nanos_to_utc(F.lit(1_700_000_000_999_999_999)), text.nanos_to_utc(F.lit(0)), text.duration_text(F.lit(999.0)),
        text.duration_text(F.lit(1005.0)), text.days_left(F.lit(-86_401), F.lit(0)), text.price(F.lit("$1,200.50")), text.price(F.lit("1.2.3")),
    ).first()
    assert tuple(row) == ("2023-11-14T22:13:20Z", "1970-01-01T00:00:00Z", "999.00ms", "1.00s", -1, 1200.5, None)


def test_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        time = F.lit("2024-03-10 02:30:00").cast("timestamp_ntz")
        row = spark.range(1).select(text.nanos_to_utc(F.lit(1_700_000_000_000_000_000)), text.wall_seconds(time)).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(row) == ("2023-11-14T22:13:20Z", 1710037800)


def test_keywords(spark):
    fields = F.create_map(F.lit("a"), F.lit("Été THE end"), F.lit("b"), F.lit("Kelvin"))
    found = lambda words, search=None: keyword_matches(fields, words, ["a", "b"], search)
    row = spark.range(1).select(
        found(["the", " END ", "", "the"]), found(["été", "té the"]), found(["kelvin"]), found(["the"], ["b"]), found(["end K"]), found(None),
    ).first()
    assert list(row) == [["the", "end", "the"], ["té the"], [], [], ["end K"], []]


def test_hash(spark):
    fields = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit(""))
    row = spark.range(1).select(content_hash(fields), content_hash(fields, [" a "]), content_hash(fields, ["a", "b"]), content_hash(fields, ["b", "x"])).first()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    whole = digest("a\0\0b\x002\0")
    assert list(row) == [whole, whole, whole, digest("b\x002\0x\0\0")]


def test_template(spark):
    fields = F.create_map(F.lit("t"), F.lit("T"), F.lit("url"), F.lit("mine"))
    line = text.render("é {t} {url} {n} {no} {a b} {{t}}", {"url": F.lit("run"), "n": F.lit(3)}, fields)
    assert spark.range(1).select(line).first()[0] == "é T mine 3  {a b} {T}"


def test_headers_and_shorthand(spark):
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), F.lit(v).alias("value"))
    row = spark.range(1).select(flatten_headers(F.array(pair("a", "1"), pair("b", "2"), pair("a", "3"))), shorthand(F.lit("n: p:x @ ")), shorthand(F.lit("n"))).first()
    assert row[0] == {"a": "1, 3", "b": "2"} and tuple(row[1]) == ("n", "p:x", "text") and row[2] is None


@pytest.mark.parametrize("count", [1, 20_000])
def test_long_texts_with_many_entities(spark, count):
    body = "&#65;b" * count
    got = spark.createDataFrame([(body,)], "t string").select(text.decode_entities(F.col("t"))).first()[0]
    assert got == "Ab" * count


def test_answers_that_are_no_success_fail_as_http(spark):
    from pagewatch.sources.pages import attempts

    log = spark.createDataFrame(
        [(1, "u", 200, None), (2, "u", 503, None), (3, "u", None, "DNS lookup failed"), (4, "u", None, None)], "id int, url string, status int, error string"
    )
    told = {r["id"]: r["failure"] for r in attempts(log).collect()}
    assert told[1] is None and tuple(told[2]) == ("http status: 503", "http") and tuple(told[3]) == ("DNS lookup failed", "dns")
    assert told[4]["kind"] == "http"


def test_kinds_of_entities_are_decoded_as_one_after_the_other(spark):
    bodies = [
        "a&#101;b&#xE9;&#101;c", "&#65;&#66;&#", "&#65; &#xZZ; &#65;", "&#65;&#xD800;&#66;", "&#65\n;&#66;", "x &# y", "&#;&#65;", "&#x+41;&#+0065;", "\U0001f600&#65;\U0001f600&#q&#65;",
        "&#6&#53;;", "&#48;" * 50, "".join(f"&#{n};" for n in range(200, 300)), "&#99999999;&#65;", "&#123456789;&#65;", "&#65", "&#0;", None,
    ]
    body = F.col("t")
    rows = spark.createDataFrame([(b,) for b in bodies], "t string").select(
        "t", text._decode_by_kind(body).alias("kinds"), text._decode_in_one_pass(body).alias("plain"), text.decode_entities(body).alias("got")
    ).collect()
    assert [r["got"] for r in rows] == [r["plain"] for r in rows]
    assert all(r["kinds"] == r["plain"] for r in rows if "\n" not in (r["t"] or ""))  # those go the plain way
