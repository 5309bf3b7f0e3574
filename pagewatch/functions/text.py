"""Text columns: white space, entities, labels, ids, durations, templates, query strings and failure kinds."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

# The named entities that are decoded, in the order in which they are replaced.
NAMED_ENTITIES = [
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&#039;", "'"),
    ("&apos;", "'"),
]

# Words that decide the kind of a failed fetch; the first line that applies wins.
FAILURE_WORDS = [
    ("blocked", ["blocked private network address", "private-network guard"]),
    ("http", ["http status:"]),
    ("dns", ["dns", "resolve"]),
    ("timeout", ["timed out", "timeout"]),
    ("tls", ["tls", "certificate"]),
    ("proxy", ["proxy"]),
    ("connect", ["connect", "connection"]),
    ("size", ["exceeds"]),
]

def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas where Spark shares no subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def squeeze(value: Column) -> Column:
    """Runs of Unicode white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def is_blank(value: Column) -> Column:
    return squeeze(F.coalesce(value, F.lit(""))) == ""


def ascii_lower(value: Column) -> Column:
    """Lower-case A-Z only; ``lower`` would fold accented letters as well."""
    return F.translate(value, UPPER, UPPER.lower())


def decode_entities(value: Column) -> Column:
    """Named entities in their fixed order, then numeric ones from the left up to the first that is not valid."""
    named = reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), NAMED_ENTITIES, value)
    return bound(
        named,
        lambda text: F.when(~F.contains(text, F.lit("&#")), text)
        .when(text.rlike(REVIVING), _decode_again_and_again(text))
        .when(text.rlike(BROKEN), _decode_in_one_pass(text))
        .otherwise(_decode_by_kind(text)),
    )


# Texts where a decoded '&' or '#' makes a new entity together with its neighbour.
AMPERSAND, HASH = r"&#(?:\+?0*38|[xX]\+?0*26);", r"&#(?:\+?0*35|[xX]\+?0*23);"
REVIVING = f"{AMPERSAND}(?:#|{HASH})|&{HASH}"
# A numeric entity that may be valid, a mark that begins none, and one with a line break before its end.
NUMERIC = r"&#(?:[xX]\+?0*[0-9a-fA-F]{1,8}|\+?0*[0-9]{1,8});"
NO_ENTITY = f"&#(?!{NUMERIC[2:]})"
BROKEN = r"&#[xX+0-9a-fA-F]+[\n\r\u0085\u2028\u2029]+;"
# Texts with more kinds of numeric entities than this are decoded one entity after the other.
ENTITY_KINDS = 32


def _entity_letter(body: Column) -> Column:
    """The character of a numeric entity body such as 65 or x41; NULL when it is not a valid one."""
    # conv reads both forms: the hex form by its base, the decimal form as it is.
    is_hex = F.upper(F.substring(body, 1, 1)) == "X"
    digits = F.regexp_extract(body, r"^(?:[xX]\+?0*([0-9a-fA-F]{1,8})|\+?0*([0-9]{1,8}))$", 1)
    decimal = F.regexp_extract(body, r"^\+?0*([0-9]{1,8})$", 1)
    code = F.when(is_hex, F.conv(F.nullif(digits, F.lit("")), 16, 10)).otherwise(F.nullif(decimal, F.lit("")))
    return bound(
        code.cast("bigint"),
        lambda c: F.when((c <= 0x10FFFF) & ~c.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")),
    )


def _decode_by_kind(text: Column) -> Column:
    """Each kind of entity is decoded once and replaced wherever it stands, up to the first mark that begins no entity."""

    def kinds(parts: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(parts[0], F.lit(NUMERIC), F.lit(0)))
        letters = F.transform(
            bound(found, lambda few: F.when(F.size(few) <= ENTITY_KINDS, few)),
            lambda e: F.struct(e.alias("entity"), _entity_letter(F.substring(e, F.lit(3), F.length(e) - 3)).alias("letter")),
        )
        return F.struct(parts.alias("parts"), letters.alias("letters"))

    def put_together(work: Column) -> Column:
        parts, letters = work["parts"], work["letters"]
        head = F.aggregate(letters, parts[0], lambda t, e: F.replace(t, e["entity"], e["letter"]))
        whole = F.when(F.size(parts) > 1, F.concat(head, F.lit("&#"), parts[1])).otherwise(head)
        some_bad = letters.isNull() | F.exists(letters, lambda e: e["letter"].isNull())
        return F.when(some_bad, _decode_in_one_pass(text)).otherwise(whole)

    return bound(bound(F.split(text, NO_ENTITY, 2), kinds), put_together)


def _decode_in_one_pass(text: Column) -> Column:
    def decoded(part: Column) -> Column:
        def entity(end: Column) -> Column:
            letter = _entity_letter(F.substring(part, F.lit(3), end - 3))
            return F.when(end > 0, F.concat(letter, F.substring(part, end + 1, F.length(part))))

        return F.when(F.startswith(part, F.lit("&#")), bound(F.locate(";", part), entity)).otherwise(part)

    def put_together(work: Column) -> Column:
        """Decoded parts up to the first bad one, then the rest as it was."""
        bad = F.array_position(F.transform(work["done"], lambda d: d.isNull()), True).cast("int")
        stopped = F.concat(
            F.slice(work["done"], F.lit(1), F.greatest(bad - 1, F.lit(0))), F.slice(work["parts"], F.greatest(bad, F.lit(1)), F.size(work["parts"]))
        )
        return F.array_join(F.when(bad == 0, work["done"]).otherwise(stopped), "")

    def work(parts: Column) -> Column:
        return F.struct(parts.alias("parts"), F.transform(parts, decoded).alias("done"))

    return bound(bound(F.split(text, "(?=&#)"), work), put_together)


def _decode_again_and_again(value: Column) -> Column:
    # Every round removes one '&', one '#' and one ';' and adds at most one of them back.
    marks = F.length(value) - F.length(F.translate(value, "&#;", ""))
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(marks / 2).cast("int")))

    def one(text: Column) -> Column:
        def entity(at: Column, end: Column) -> Column:
            letter = F.when(end > at, _entity_letter(F.substring(text, at + 2, end - at - 2)))
            return F.concat(F.substring(text, F.lit(1), at - 1), letter, F.substring(text, end + 1, F.length(text)))

        next_end = lambda at: bound(F.call_function("locate", F.lit(";"), text, at), lambda end: entity(at, end))
        return bound(F.locate("&#", text), next_end)

    def advance(state: Column, _: Column) -> Column:
        """A NULL in ``next`` means that nothing more can be decoded."""
        following = F.struct(F.coalesce(state["next"], state["text"]).alias("text"), one(state["next"]).alias("next"))
        return F.when(state["next"].isNull(), state).otherwise(following)

    last = F.aggregate(rounds, F.struct(value.alias("text"), one(value).alias("next")), advance)
    return F.coalesce(last["next"], last["text"])


def clean(value: Column) -> Column:
    return squeeze(decode_entities(value))


def job_id(name: Column) -> Column:
    """Letters and digits in lower case, anything else an underscore, none at the ends."""
    letters = F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{N}]", "_")
    return F.regexp_replace(F.lower(letters), r"^_+|_+$", "")


def nanos_to_utc(nanos: Column) -> Column:
    """Whole seconds in UTC, ISO form with a Z, whatever the session time zone; exact for any 64-bit value."""

    def whole(value: Column, unit: int) -> Column:
        return F.call_function("div", value - F.pmod(value, F.lit(unit)), F.lit(unit))

    def written(seconds: Column) -> Column:
        rest = F.pmod(seconds, F.lit(86_400))
        day = F.date_from_unix_date(whole(seconds, 86_400).cast("int")).cast("string")
        parts = [whole(rest, 3600), whole(F.pmod(rest, F.lit(3600)), 60), F.pmod(rest, F.lit(60))]
        clock = F.concat_ws(":", *[F.lpad(part.cast("string"), 2, "0") for part in parts])
        return F.concat(day, F.lit("T"), clock, F.lit("Z"))

    return bound(whole(nanos, 1_000_000_000), written)


def wall_seconds(time: Column) -> Column:
    """Seconds since 1970 of a time without zone, read as UTC."""
    return F.unix_date(time.cast("date")) * F.lit(86_400).cast("bigint") + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def duration_text(millis: Column) -> Column:
    """Seconds from one second on, else milliseconds, with two decimals of the exact binary value."""

    def two_decimals(value: Column) -> Column:
        return F.call_function("format_number", value, F.lit("0.00"))

    return F.when(millis >= 1000, F.concat(two_decimals(millis / 1000.0), F.lit("s"))).otherwise(
        F.concat(two_decimals(millis), F.lit("ms"))
    )


def label(name: Column) -> Column:
    """Underscores become spaces and each part gets a capital first letter; the rest of the part is left alone."""
    parts = F.transform(F.split(name, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p))))
    return F.array_join(parts, " ")


def label_of(name: str) -> str:
    return " ".join(part[:1].upper() + part[1:] for part in name.split("_"))


def failure_kind(message: Column) -> Column:
    text = ascii_lower(message)
    kind = F
    for name, words in FAILURE_WORDS:
        hit = reduce(lambda a, b: a | b, [F.contains(text, F.lit(word)) for word in words])
        kind = kind.when(hit, name)
    return kind.otherwise("unknown")


TAG = re.compile(r"\{([A-Za-z0-9_]+)\}")


def render(template: str, tags: dict[str, Column], fields: Column | None = None) -> Column:
    """Fill ``{name}`` marks from ``fields`` (a map, wins) or ``tags``; unknown names become empty text."""
    parts: list[Column] = []
    at = 0
    for mark in TAG.finditer(template):
        if mark.start() > at:
            parts.append(F.lit(template[at:mark.start()]))
        choices = [] if fields is None else [F.element_at(fields, F.lit(mark[1]))]
        choices += [tags[mark[1]].cast("string")] if mark[1] in tags else []
        parts.append(F.coalesce(*choices, F.lit("")))
        at = mark.end()
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def url_decode(value: Column) -> Column:
    """Plus is a space; an escape that is not two hex digits stays as written; bytes that are not UTF-8 give empty text."""
    # A '%' takes the next two characters with it, valid or not, so '%%41' does not hide an escape.
    tokens = F.regexp_extract_all(value, F.lit(r"(?s)(%.{0,2}|[^%]+)"), F.lit(1))
    pairs = F.transform(
        tokens,
        lambda t: F.when(t.rlike(r"^%[0-9A-Fa-f]{2}$"), F.upper(F.substring(t, 2, 2)))
        .when(t.rlike(r"^%\+[0-9A-Fa-f]$"), F.concat(F.lit("0"), F.substring(t, 3, 1)))
        .when(F.startswith(t, F.lit("%")), F.hex(F.encode(t, "UTF-8")))
        .otherwise(F.hex(F.encode(F.replace(t, F.lit("+"), F.lit(" ")), "UTF-8"))),
    )
    raw = F.unhex(F.array_join(pairs, ""))
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.lit(""))


def query_pairs(url: Column) -> Column:
    """array<struct<pos,key,value>> of the query string after the first '?'; empty pairs are skipped."""
    text = F.when(F.contains(url, F.lit("?")), F.substring(url, F.locate("?", url) + 1, F.length(url))).otherwise(F.lit(""))
    pairs = F.filter(F.split(text, "&"), lambda p: p != "")
    def pair(p: Column, pos: Column) -> Column:
        cut = F.locate("=", p)
        key = F.when(cut > 0, F.substring(p, F.lit(1), cut - 1)).otherwise(p)
        value = F.when(cut > 0, F.substring(p, cut + 1, F.length(p))).otherwise(F.lit(""))
        return F.struct(pos.alias("pos"), url_decode(key).alias("key"), url_decode(value).alias("value"))
    return F.transform(pairs, pair)


def price(text: Column) -> Column:
    """Digits and dots only, read as a number; NULL when that is not a number."""
    return F.regexp_replace(text, r"[^0-9.]", "").try_cast("double")


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"[0-9]+", 0).try_cast("double")


def days_left(expires: Column, now: Column) -> Column:
    """Whole days between two times in seconds, toward zero."""
    return F.call_function("div", expires - now, F.lit(86_400))
