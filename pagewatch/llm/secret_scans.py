"""Secrets in documents: Boolean trigram queries over an inverted index pick candidates, and the rules verify them.

A rule's regular expression is read for the strings it cannot match without, which become a disjunction of sets of
trigrams. Postings of exactly these trigrams are made from lower-cased texts; a rule's candidates are the documents in
all postings of one of its sets. A rule that needs no string of three characters has no such query and reads all texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as ops, _parser as reader

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pagewatch.session import durable, small


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int


# The rules of the contract.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)

#: Strings that a part of an expression may stand for before the part counts as open.
CHOICES = 64
Query = frozenset  # of frozensets of trigrams: any of these sets, all of its trigrams
ANY: Query = frozenset({frozenset()})


def least_sets(query: set) -> Query:
    return frozenset(s for s in query if not any(t < s for t in query))


def both(a: Query, b: Query) -> Query:
    return least_sets({x | y for x in a for y in b})


def needed(strings: set[str]) -> Query:
    """One of ``strings`` occurs; strings under three characters need nothing."""
    return least_sets({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case, without which ``pattern`` matches nothing. ``ANY`` if there are none."""

    def several(items) -> tuple[set[str] | None, Query]:
        """The strings of the part if it stands for few, else None; and what it needs apart from them."""
        whole, strings, query = True, {""}, ANY
        for op, value in items:
            part, needs = one(op, value)
            if part is not None and len(part) * len(strings) <= CHOICES:
                strings = {a + b for a, b in product(strings, part)}
                continue
            query = both(both(query, needed(strings)), needs if part is None else needed(part))
            whole, strings = False, {""}
        return (strings, ANY) if whole else (None, both(query, needed(strings)))

    def one(op, value) -> tuple[set[str] | None, Query]:
        if op is ops.LITERAL:
            return {chr(value).lower()}, ANY
        if op is ops.IN:
            signs = [chr(v).lower() if kind is ops.LITERAL else None for kind, v in value]
            return (set(signs), ANY) if None not in signs else (None, ANY)
        if op is ops.AT:
            return {""}, ANY
        if op is ops.SUBPATTERN:
            return several(value[3])
        if op is ops.BRANCH:
            parts = [several(items) for items in value[1]]
            if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= CHOICES:
                return set().union(*(s for s, _ in parts)), ANY
            return None, least_sets(set().union(*(needed(s) if s is not None else q for s, q in parts)))
        if op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            low, high, items = value
            strings, query = several(items)
            if strings is not None and high <= 4 and sum(len(strings) ** k for k in range(low, high + 1)) <= CHOICES:
                return {"".join(p) for k in range(low, high + 1) for p in product(strings, repeat=k)}, ANY
            if low == 0:
                return None, ANY
            return None, needed(strings) if strings is not None else query
        return None, ANY

    strings, query = several(reader.parse(pattern))
    return needed(strings) if strings is not None else query


def key(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, h, n, text) of all rows: rows of one id and text share the key (id, h, n). A null text is empty."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return df.select(F.col(id_column).alias("id"), text.alias("text")).select("id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"), "text")


def same_key(left: str, right: str) -> Column:
    return F.expr(f"{left}.h = {right}.h AND {left}.n = {right}.n AND {left}.id <=> {right}.id")


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, id, h, n): which keys hold which of ``trigrams``, regardless of case."""

    def held(text: Column) -> Column:
        return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in trigrams]))

    return rows.select("id", "h", "n", F.explode(F.flatten(F.transform(F.array(F.lower("text")), held))).alias("trigram")).distinct()


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(id, h, n, kinds): the rules whose trigram query a key answers. Postings of a set are intersected by counting."""
    rows = [(kind, number, len(s), t) for kind, query in queries.items() for number, s in enumerate(sorted(query, key=sorted)) for t in sorted(s)]
    kinds = {"kind": pa.string(), "part": pa.int32(), "size": pa.int32(), "trigram": pa.string()}
    # An Arrow table needs no Python workers.
    asked = index.sparkSession.createDataFrame(pa.table({name: pa.array([row[at] for row in rows], kind) for at, (name, kind) in enumerate(kinds.items())}))
    whole = index.join(F.broadcast(asked), "trigram").groupBy("id", "h", "n", "kind", "part", "size").agg(F.count("*").alias("met")).where("met = size")
    return whole.groupBy("id", "h", "n").agg(F.collect_set("kind").alias("kinds"))


def matches(text: Column, rule: Rule) -> Column:
    """[(start, end)] of a rule in code points, end exclusive. Each match is read with the gap before it, from where the
    match before it ended, so lengths add up to places."""
    step = F.lit(rf"(?s)\G(.*?)({rule.pattern})")
    gaps, found = F.regexp_extract_all(text, step, F.lit(1)), F.regexp_extract_all(text, step, F.lit(2))
    value = found if rule.group == 0 else F.regexp_extract_all(text, step, F.lit(2 + rule.group))
    parts = F.arrays_zip(F.transform(gaps, F.char_length).alias("gap"), F.transform(found, F.char_length).alias("long"), F.transform(value, F.char_length).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, p: Column) -> Column:
        at = state["at"] + p["gap"]
        span = F.struct(at.alias("start"), (at + p["long"]).alias("end"))
        return F.struct((at + p["long"]).alias("at"), F.when(p["value"] >= rule.least, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(parts, start, add, lambda state: state["spans"])


def listed(text: Column, rules: list[tuple[int, Rule]], wanted) -> Column:
    """[(start, place of the kind, end)] of the rules for which ``wanted(rule)`` holds in a row."""
    none = F.array().cast("array<struct<start:int,place:int,end:int>>")
    each = [F.when(wanted(rule), spread(matches(text, rule), place)).otherwise(none) for place, rule in rules]
    return F.concat(none, *each)


def spread(spans: Column, place: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end")))


def found_spans(df: DataFrame, rules: tuple[Rule, ...], id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """All keyed rows of ``df`` with the spans of rules that read all texts, and (id, h, n, more) of the other rules."""
    rows = key(df, id_column, text_column)
    placed = list(enumerate(rules))
    queries = {rule.kind: query for rule in rules if (query := trigram_query(rule.pattern)) != ANY}
    scanned = [(i, r) for i, r in placed if r.kind not in queries]
    # A cheap test for a text that can hold a long enough run saves the exact reading of most texts.
    rows = rows.withColumn("spans", listed(F.col("text"), scanned, lambda r: F.col("text").rlike(r.pattern[:-1] + f"{{{r.least},}}") if r.pattern.endswith("]+") and r.group == 0 else F.lit(True)))
    if not queries:
        return rows, rows.select("id", "h", "n", F.col("spans").alias("more")).limit(0)
    index = durable(postings(rows, sorted({t for q in queries.values() for s in q for t in s})))
    named = durable(candidates(index, queries))
    close = key(df, id_column, text_column).alias("d").join(small(named).alias("c"), same_key("d", "c")).select("d.id", "d.h", "d.n", "d.text", "c.kinds")
    more = close.select("id", "h", "n", listed(F.col("text"), [(i, r) for i, r in placed if r.kind in queries], lambda r: F.array_contains("kinds", r.kind)).alias("more"))
    return rows, more.groupBy("id", "h", "n").agg(F.first("more").alias("more")).where(F.size("more") > 0)


def with_spans(df: DataFrame, rules: tuple[Rule, ...], id_column: str, text_column: str, keep_text: bool) -> DataFrame:
    rows, more = found_spans(df, rules, id_column, text_column)
    rows = rows if keep_text else rows.drop("text")
    none = F.array().cast("array<struct<start:int,place:int,end:int>>")
    joined = rows.alias("d").join(more.alias("m"), same_key("d", "m"), "left")
    return joined.select("d.*", F.array_sort(F.concat("d.spans", F.coalesce("m.more", none))).alias("all")).drop("spans")


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_<kind> for every rule, base_sha256, spans) for every row of ``df``.

    ``spans`` lists kind:start:end, by start and then by the order of ``rules``; the checksum is that of the listed text
    for the rules in ``RULES``. A null or empty text holds nothing, and gets an empty list. Repeated rows and rows with
    a null id get their own lines. Other columns are not read.
    """
    rows = with_spans(df, rules, id_column, text_column, keep_text=False)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = [i for i, r in enumerate(rules) if r in RULES]

    def text_of(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(place: int) -> Column:
        return F.size(F.filter("all", lambda s: s["place"] == place)).cast("long")

    of_base = F.filter("all", lambda s: s["place"].isin(base))
    return rows.select(F.col("id").alias(id_column), *[number(i).alias(f"n_{r.kind}") for i, r in enumerate(rules)], F.sha2(text_of(of_base), 256).alias("base_sha256"), text_of(F.col("all")).alias("spans"))


def redact(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text", sign: str = "[SECRET]") -> DataFrame:
    """``df`` with every secret of its texts replaced by ``sign``; overlapping secrets become one. Null texts stay null."""
    spans = with_spans(df, rules, id_column, text_column, keep_text=False).select("id", "h", "n", "all").where(F.size("all") > 0)
    spans = spans.groupBy("id", "h", "n").agg(F.first("all").alias("all"))
    text = F.coalesce(F.col(f"d.{text_column}"), F.lit(""))
    marked = df.alias("d").join(spans.alias("s"), (F.xxhash64(text) == F.col("s.h")) & (F.octet_length(text) == F.col("s.n")) & F.col(f"d.{id_column}").eqNullSafe(F.col("s.id")), "left")

    def cut(body: Column, found: Column) -> Column:
        def step(state: Column, s: Column) -> Column:
            fresh = s["start"] >= state["at"]
            between = F.when(fresh, F.concat(F.substring(body, state["at"] + 1, s["start"] - state["at"]), F.lit(sign))).otherwise("")
            return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], between).alias("out"))

        rest = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
        return F.concat(rest["out"], F.substring(body, rest["at"] + 1, F.char_length(body)))

    clean = F.when(F.col("s.all").isNull(), F.col(f"d.{text_column}")).otherwise(cut(F.col(f"d.{text_column}"), F.col("s.all")))
    return marked.select(*[clean.alias(c) if c == text_column else F.col(f"d.`{c}`") for c in df.columns])
