"""Keyword matching on item fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pagewatch.functions.text import ascii_lower, bound, strip


def lowered(keywords: Sequence[str] | None) -> list[str]:
    """Trimmed, A-Z lower-cased, blanks dropped, order and repeats kept."""
    ascii_fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [k.strip().translate(ascii_fold) for k in keywords or [] if k.strip()]


def haystack(fields: Column, names: Sequence[str]) -> Column:
    return F.concat_ws(" ", *[F.element_at(fields, F.lit(name)) for name in names])


def whole_haystack(fields: Column, names: Sequence[str]) -> Column:
    """All values: those of ``names`` in their order, then those of fields that a hook added, by name."""
    known = F.array(*[F.lit(name) for name in names]) if names else F.array().cast("array<string>")
    added = F.transform(F.array_sort(F.array_except(F.map_keys(fields), known)), lambda name: F.element_at(fields, name))
    return F.concat_ws(" ", *[F.element_at(fields, F.lit(name)) for name in names], added)


def _folded_for_ascii(text: Column) -> Column:
    """Lower case, good for finding ASCII words: the two capitals that ``lower`` turns into ASCII are taken out first."""
    kept = F.replace(F.replace(text, F.lit("\u212a"), F.lit("\ufffd")), F.lit("\u0130"), F.lit("\ufffd"))
    return F.lower(kept)


def keyword_matches(
    fields: Column,
    keywords: Sequence[str] | None,
    field_names: Sequence[str],
    search_fields: Sequence[str] | None = None,
) -> Column:
    """Keywords found in the searched fields, in keyword order. Without ``search_fields`` all fields are searched, in
    their declared order, and undeclared ones after them."""
    words = lowered(keywords)
    if not words:
        return F.array().cast("array<string>")
    text = whole_haystack(fields, field_names) if search_fields is None else haystack(fields, search_fields)
    # ``lower`` is many times faster than ``translate``; only words with other letters need the exact A-Z folding.
    fold = _folded_for_ascii if all(w.isascii() for w in words) else ascii_lower
    return bound(fold(text), lambda hay: F.filter(F.array(*[F.lit(w) for w in words]), lambda word: F.contains(hay, word)))


def lowered_words(keywords: Column) -> Column:
    """``lowered`` for a column of keyword lists; a missing list is empty."""
    words = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: ascii_lower(strip(k)))
    return F.filter(words, lambda w: w != "")


def keyword_matches_by(fields: Column, words: Column, names: Column, searched: Column) -> Column:
    """``keyword_matches`` where every row brings its own ``lowered_words``, declared field names and searched fields."""
    declared = F.array_distinct(names)
    added = F.array_sort(F.array_except(F.map_keys(fields), declared))
    places = F.when(searched.isNull(), F.concat(declared, added)).otherwise(searched)
    text = F.concat_ws(" ", F.transform(places, lambda name: F.element_at(fields, name)))
    plain = ~F.exists(words, lambda w: F.rlike(w, F.lit("[^\\x00-\\x7f]")))
    hay = F.when(F.size(words) == 0, "").when(plain, _folded_for_ascii(text)).otherwise(ascii_lower(text))
    return bound(hay, lambda hay: F.filter(words, lambda word: F.contains(hay, word)))


def keeps(keywords: Sequence[str] | None, matches: Column) -> Column:
    """No keywords keep everything; otherwise at least one must match."""
    return F.size(matches) > 0 if keywords else F.lit(True)
