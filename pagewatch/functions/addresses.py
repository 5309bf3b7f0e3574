"""Private and reserved network addresses, as plain comparisons on packed numbers and hex text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from pagewatch.functions.text import bound

# Reserved IPv4 blocks as (first address, prefix length).
RESERVED_V4 = [
    ("0.0.0.0", 8),
    ("10.0.0.0", 8),
    ("100.64.0.0", 10),
    ("127.0.0.0", 8),
    ("169.254.0.0", 16),
    ("172.16.0.0", 12),
    ("192.0.0.0", 24),
    ("192.0.2.0", 24),
    ("192.88.99.0", 24),
    ("192.168.0.0", 16),
    ("198.18.0.0", 15),
    ("198.51.100.0", 24),
    ("203.0.113.0", 24),
    ("224.0.0.0", 4),
    ("240.0.0.0", 4),
]

# Reserved IPv6 blocks as (leading hex digits with x for a free one), besides those that hold an IPv4.
RESERVED_V6 = [
    "000000000000000000000000",
    "0064ff9b0001",
    "0100000000000000",
    "20010000",
    "20010db8",
    "200100020000",
    "2001001",
    "2001002",
    "3fff0",
    "fc",
    "fd",
    "fe8",
    "fe9",
    "fea",
    "feb",
    "fec",
    "fed",
    "fee",
    "fef",
    "ff",
]

# IPv6 prefixes that carry an IPv4 address, with the position of its eight hex digits (1-based).
CARRIES_V4 = [
    ("00000000000000000000ffff", 25),
    ("0000000000000000ffff0000", 25),
    ("0064ff9b0000000000000000", 25),
    ("2002", 5),
]


def v4_number(text: Column) -> Column:
    """Packed IPv4, NULL for anything but four decimal parts up to 255."""
    part = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    parts = F.split(text, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, p: n * 256 + p.try_cast("bigint"))
    return F.when(text.rlike(rf"^{part}(\.{part}){{3}}$"), number)


def v4_forbidden(number: Column) -> Column:
    def within(block: tuple[str, int]) -> Column:
        first = reduce(lambda n, p: n * 256 + int(p), block[0].split("."), 0)
        return number.between(first, first + 2 ** (32 - block[1]) - 1)

    return reduce(lambda a, b: a | b, [within(block) for block in RESERVED_V4])


def v6_hex(text: Column) -> Column:
    """The 32 hex digits of an IPv6 address, NULL when it does not have eight groups."""

    def written_out(value: Column) -> Column:
        tail = F.regexp_extract(value, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
        packed = F.lpad(F.lower(F.hex(v4_number(tail))), 8, "0")
        front = F.substring(value, F.lit(1), F.length(value) - F.length(tail))
        dotted = F.concat(front, F.substring(packed, 1, 4), F.lit(":"), F.substring(packed, 5, 4))
        return F.lower(F.when(tail == "", value).otherwise(dotted))

    def digits_of(plain: Column) -> Column:
        malformed = plain.rlike(r"[^0-9a-f:]|[0-9a-f]{5}|::.*::|:::|^:[^:]|[^:]:$")
        right = F.substring(plain, F.locate("::", plain) + 2, F.length(plain))
        sides = F.struct(
            _groups(F.substring_index(plain, "::", 1)).alias("left"),
            F.when(F.contains(plain, F.lit("::")), _groups(right)).alias("right"),
        )
        return F.when(~malformed, bound(sides, _filled))

    return bound(bound(text, written_out), digits_of)


def _groups(side: Column) -> Column:
    return F.transform(F.filter(F.split(side, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))


def _filled(sides: Column) -> Column:
    """Both sides of a '::' with zero groups between; without one the left side must be complete."""
    missing = 8 - F.size(sides["left"]) - F.size(F.coalesce(sides["right"], F.array().cast("array<string>")))
    zeros = F.array_repeat(F.lit("0000"), F.greatest(missing, F.lit(0)))
    digits = F.when(sides["right"].isNull(), F.array_join(sides["left"], "")).otherwise(
        F.array_join(F.concat(sides["left"], zeros, sides["right"]), "")
    )
    return bound(digits, lambda d: F.when(F.length(d) == 32, d))


def v6_forbidden(digits: Column) -> Column:
    def verdict(value: Column) -> Column:
        reserved = reduce(lambda a, b: a | b, [F.startswith(value, F.lit(block)) for block in RESERVED_V6])
        chain = F
        for prefix, at in CARRIES_V4:
            inner = F.conv(F.substring(value, at, 8), 16, 10).cast("bigint")
            chain = chain.when(F.startswith(value, F.lit(prefix)), bound(inner, v4_forbidden))
        return chain.otherwise(reserved)

    return bound(digits, lambda value: F.when(value.isNotNull(), verdict(value)))


def is_forbidden(address: Column) -> Column:
    """True for private, local, reserved or documentation addresses; NULL when the text is not an address."""
    v4 = bound(v4_number(address), v4_forbidden)
    return F.when(F.contains(address, F.lit(":")), v6_forbidden(v6_hex(address))).otherwise(v4)
