"""CSS selectors as predicates on the node array of a page.

A selector text is read once on the driver; what comes out is a Column over ``nodes``. ``path`` selection is the
literal mode: descendant and child steps, each step expanding from every match of the step before it, so a node below
two matching ancestors comes out twice. ``css`` selection covers attributes, lists, siblings and some pseudo-classes,
and returns each node once, in document order.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, functions as F

from pagewatch.operators.nodes import FOLD

Predicate = Callable[[Column], Column]

TOKEN = re.compile(
    r"""\s*(?:
      (?P<comma>,)\s* | (?P<join>[>+~])\s* | (?P<any>\*) | (?P<tag>[A-Za-z_][\w-]*) | \#(?P<id>[\w-]+) | \.(?P<cls>[\w-]+)
      | \[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*(?P<fold>[iI])?\s*)?\]
      | :(?P<pseudo>[a-z-]+)(?:\((?P<arg>(?:[^()]|\([^()]*\))*)\))?
    )""",
    re.VERBOSE,
)
# The literal grammar: steps with what joins them, and in a step the tag and the marked names.
LITERAL = re.compile(r"\s*(?P<join>(?:>\s*)*)(?P<step>[^\s>]+)")
NAMED = re.compile(r"(?P<tag>[^#.\[:]*)(?P<marks>(?:[#.][^#.\[:]*)*)")
MARK = re.compile(r"[#.][^#.]*")
ODD_TOKEN = re.compile(r"[+~*,]")
# Pseudo-classes of position: whether it is among siblings of the same tag, counted from the end, and which it is.
POSITIONS = {
    "nth-child": (False, False, ""), "first-child": (False, False, "1"), "last-child": (False, True, "1"), "nth-last-child": (False, True, ""),
    "nth-of-type": (True, False, ""), "first-of-type": (True, False, "1"), "last-of-type": (True, True, "1"), "nth-last-of-type": (True, True, ""),
}
LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NTH = re.compile(r"\s*(?:(?P<word>odd|even)|(?P<a>[+-]?\d*)n\s*(?P<b>[+-]\s*\d+)?|(?P<n>[+-]?\d+))\s*$")


@dataclass(frozen=True)
class Compound:
    """One step: everything that must hold for a single node."""

    tag: str | None = None
    id: str | None = None
    classes: tuple[str, ...] = ()
    attrs: tuple[tuple[str, str, str, bool], ...] = ()
    pseudos: tuple[tuple[str, str], ...] = ()

    def test(self, node: Column, nodes: Column) -> Column:
        checks = []
        if self.tag:
            checks.append(node["tag"] == self.tag)
        if self.id:
            checks.append(F.coalesce(node["id_attr"], F.lit("")) == self.id)
        checks += [F.array_contains(node["classes"], name) for name in self.classes]
        checks += [_attribute_check(node, *attr) for attr in self.attrs]
        checks += [_pseudo_check(node, nodes, *pseudo) for pseudo in self.pseudos]
        return reduce(lambda a, b: a & b, checks) if checks else F.lit(True)


@dataclass(frozen=True)
class Step:
    join: str
    compound: Compound


def _attribute_check(node: Column, name: str, op: str, wanted: str, folded: bool) -> Column:
    value = F.element_at(node["attrs"], F.lit(name.translate(FOLD)))
    if op == "":
        return value.isNotNull()
    text = F.coalesce(value, F.lit(""))
    if folded:
        text, wanted = F.translate(text, *LETTERS), wanted.translate(FOLD)
    if op == "=":
        return value.isNotNull() & (text == wanted)
    if op == "|=":
        return value.isNotNull() & ((text == wanted) | F.startswith(text, F.lit(f"{wanted}-")))
    if wanted == "":
        return F.lit(False)
    return {
        "^=": F.startswith(text, F.lit(wanted)),
        "$=": F.endswith(text, F.lit(wanted)),
        "*=": F.contains(text, F.lit(wanted)),
        "~=": F.array_contains(F.split(text, r"(?U)\s+"), wanted),
    }[op]


def _pseudo_check(node: Column, nodes: Column, name: str, arg: str) -> Column:
    if name in POSITIONS:
        of_type, from_end, fixed = POSITIONS[name]
        position, count = _position_of_type(node, nodes) if of_type else (node["child_no"], node["siblings"])
        return _nth_check(count - position + 1 if from_end else position, fixed or arg)
    if name == "only-child":
        return node["siblings"] == 1
    if name == "only-of-type":
        return _position_of_type(node, nodes)[1] == 1
    if name == "root":
        return node["parent"] == -1
    if name == "empty":  # neither elements nor text
        return (node["last"] == node["id"]) & (node["seg_from"] == node["seg_to"])
    if name == "has":
        return reduce(lambda a, b: a | b, [F.size(reduce(lambda found, step: _expand(found, step, nodes), path, F.array(node))) > 0 for path in read_css(arg, relative=True)])
    if name not in ("not", "is", "where"):
        raise ValueError(f"pseudo-class :{name} is not supported")
    inner = reduce(lambda a, b: a | b, [c.test(node, nodes) for c in _single_compounds(arg)])
    return ~inner if name == "not" else inner


def _position_of_type(node: Column, nodes: Column) -> tuple[Column, Column]:
    """The place of a node among its siblings of the same tag, and how many there are."""
    family = F.when(node["parent"] < 0, nodes).otherwise(F.slice(nodes, node["parent"] + 2, F.get(nodes, node["parent"])["last"] - node["parent"]))
    alike = F.filter(family, lambda d: (d["parent"] == node["parent"]) & (d["tag"] == node["tag"]))
    return F.size(F.filter(alike, lambda d: d["id"] <= node["id"])), F.size(alike)


def _nth_check(position: Column, arg: str) -> Column:
    found = NTH.match(arg)
    if not found:
        raise ValueError(f"cannot read the position {arg!r}")
    if found["word"]:
        return position % 2 == (1 if found["word"] == "odd" else 0)
    if found["n"]:
        return position == int(found["n"])
    a = {"": 1, "+": 1, "-": -1}.get(found["a"]) or int(found["a"] or 1)
    b = int((found["b"] or "0").replace(" ", ""))
    if a == 0:
        return position == b
    return ((position - b) % abs(a) == 0) & ((position - b) * (1 if a > 0 else -1) >= 0)


def _single_compounds(text: str) -> list[Compound]:
    paths = read_css(text)
    if any(len(path) != 1 or path[0].join != " " for path in paths):
        raise ValueError(f"only simple selectors can stand inside a pseudo-class, not {text!r}")
    return [path[0].compound for path in paths]


def read_path(text: str) -> list[Step] | None:
    """The literal grammar: tag#id.class steps with spaces and '>'. None when it cannot read the text."""
    steps = [literal_step(found["step"], ">" if found["join"] else " ") for found in LITERAL.finditer(text)]
    return steps if steps and None not in steps else None


def literal_step(text: str, join: str) -> Step | None:
    """A step that names something; the last of several ids counts, and a mark without a name says nothing."""
    found = NAMED.fullmatch(text)
    if found is None:
        return None
    marks = [(sign[0], sign[1:]) for sign in MARK.findall(found["marks"]) if len(sign) > 1]
    named = {sign: tuple(name for mark, name in marks if mark == sign) for sign in "#."}
    compound = Compound(found["tag"].translate(FOLD) or None, (None, *named["#"])[-1], named["."])
    return None if compound == Compound() else Step(join, compound)


def read_css(text: str, relative: bool = False) -> list[list[Step]]:
    """A selector list: one path per comma-separated part, which may start with a join if it is ``relative`` to a node.
    Raises on anything that is not understood."""
    paths: list[list[Step]] = []
    steps: list[Step] = []
    compound, join, at = None, " ", 0
    text = text.strip()

    def end_step() -> None:
        nonlocal compound, join
        if compound is not None:
            steps.append(Step(join, compound))
        compound, join = None, " "

    while at < len(text):
        token = TOKEN.match(text, at)
        if token is None:
            raise ValueError(f"cannot read selector {text!r} at {text[at:]!r}")
        spaced = text[at].isspace()
        at = token.end()
        if token["comma"]:
            end_step()
            if not steps:
                raise ValueError(f"empty part in selector list {text!r}")
            paths.append(steps)
            steps = []
            continue
        if token["join"]:
            end_step()
            if not steps and not (relative and join == " "):
                raise ValueError(f"selector {text!r} starts with {token['join']!r}")
            join = token["join"]
            continue
        if spaced:
            end_step()
        compound = _extend(compound or Compound(), token)
    if join != " " and compound is None:
        raise ValueError(f"selector {text!r} ends with {join!r}")
    end_step()
    if not steps:
        raise ValueError(f"empty selector {text!r}")
    return [*paths, steps]


def _extend(compound: Compound, token: re.Match) -> Compound:
    if token["tag"]:
        return replace(compound, tag=token["tag"].translate(FOLD))
    if token["id"]:
        return replace(compound, id=token["id"])
    if token["cls"]:
        return replace(compound, classes=(*compound.classes, token["cls"]))
    if token["attr"]:
        wanted = next((v for v in (token["dq"], token["sq"], token["bare"]) if v is not None), "")
        return replace(compound, attrs=(*compound.attrs, (token["attr"], token["op"] or "", wanted, bool(token["fold"]))))
    if token["pseudo"]:
        return replace(compound, pseudos=(*compound.pseudos, (token["pseudo"], token["arg"] or "")))
    return compound


def literal_only(text: str) -> bool:
    """The literal grammar reads the text and means what CSS means by it."""
    return read_path(text) is not None and not ODD_TOKEN.search(text)


def subtree(nodes: Column, node: Column) -> Column:
    """Descendants of ``node``: a slice, since ids follow document order."""
    return F.slice(nodes, node["id"] + 2, node["last"] - node["id"])


def with_self(nodes: Column, node: Column) -> Column:
    return F.slice(nodes, node["id"] + 1, node["last"] - node["id"] + 1)


def _expand(current: Column, step: Step, nodes: Column) -> Column:
    def below(node: Column) -> Column:
        if step.join == " ":
            return F.filter(subtree(nodes, node), lambda d: step.compound.test(d, nodes))
        if step.join == ">":
            return F.filter(subtree(nodes, node), lambda d: (d["parent"] == node["id"]) & step.compound.test(d, nodes))
        # Siblings follow the node's own subtree.
        later = F.slice(nodes, node["last"] + 2, F.greatest(F.size(nodes) - node["last"] - 1, F.lit(0)))
        near = (lambda d: d["child_no"] == node["child_no"] + 1) if step.join == "+" else (lambda d: F.lit(True))
        return F.filter(later, lambda d: (d["parent"] == node["parent"]) & near(d) & step.compound.test(d, nodes))

    return F.flatten(F.transform(current, below))


def select_path(nodes: Column, steps: list[Step]) -> Column:
    """All matches of a literal path, repeats kept. A leading '>' has no effect."""
    first = F.filter(nodes, lambda d: steps[0].compound.test(d, nodes))
    return reduce(lambda current, step: _expand(current, step, nodes), steps[1:], first)


def select_first_within(nodes: Column, root: Column, steps: list[Step]) -> Column:
    """First match of a literal path inside ``root``; the root itself can be the first step unless that is a child step."""
    scope = with_self(nodes, root) if steps[0].join == " " else subtree(nodes, root)
    first = F.filter(scope, lambda d: steps[0].compound.test(d, nodes))
    return F.get(reduce(lambda current, step: _expand(current, step, nodes), steps[1:], first), F.lit(0))


def _css_ids(nodes: Column, scope: Column, paths: list[list[Step]]) -> Column:
    def ids(steps: list[Step]) -> Column:
        current = F.filter(scope, lambda d: steps[0].compound.test(d, nodes))
        for step in steps[1:]:
            # Matches are made distinct after every step, so nested ancestors do not multiply the work.
            current = _nodes_at(nodes, F.array_distinct(F.transform(_expand(current, step, nodes), lambda d: d["id"])))
        return F.transform(current, lambda d: d["id"])

    return F.array_sort(F.array_distinct(F.flatten(F.array(*[ids(steps) for steps in paths]))))


def _nodes_at(nodes: Column, ids: Column) -> Column:
    return F.transform(ids, lambda i: F.get(nodes, i))


def select_css(nodes: Column, paths: list[list[Step]]) -> Column:
    """All matches of a selector list, each once, in document order."""
    return _nodes_at(nodes, _css_ids(nodes, nodes, paths))


def css_first_within(nodes: Column, root: Column, paths: list[list[Step]], whole_page: bool) -> Column:
    """The root itself if it matches, else its first matching descendant.

    With ``whole_page`` ancestors outside the root may take part in the match; otherwise the root is all there is.
    """
    ids = _css_ids(nodes, nodes if whole_page else with_self(nodes, root), paths)
    inside = F.filter(ids, lambda i: (i >= root["id"]) & (i <= root["last"]))
    return F.get(nodes, F.get(inside, F.lit(0)))
