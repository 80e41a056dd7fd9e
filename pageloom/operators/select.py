"""CSS selectors as array expressions over a page's elements.

Type, ``*``, ``.class``, ``#id``, ``[a]``, ``[a=v]`` and the ``* ^ $ ~ |``
variants, escaped names, ``:not() :has() :is()`` of simple selectors,
``:first-child :last-child :only-child :nth-child() :nth-last-child()``,
descendant, child and sibling combinators, and comma lists.

A chain is matched step by step for all elements at once: an array of flags says
where the steps so far hold, and the next step looks its flags up by the id of the
parent or the sibling before. Ancestors and earlier siblings are reached by doubling
the steps of those links, so a page of n elements takes n log n at most, however
deep or wide it is.

A selector is written into the plan, or it is data: ``plan`` turns its text into
nested arrays, and ``match_ids_by`` interprets a column of such plans, a different
one in each row if need be.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.base import let, unnest
from pageloom.operators import dom

_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\[0-9a-fA-F]{1,6}\s?|\\[^0-9a-fA-F])+"
_SIMPLE = re.compile(
    rf"""(?P<type>\*|(?!-?\d){_NAME})|\.(?P<cls>{_NAME})|\#(?P<id>{_NAME})"""
    rf"""|\[\s*(?P<attr>(?:[\w:-]|\\.)+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>{_NAME}))\s*)?\]"""
    r"""|:(?P<pseudo>[a-z-]+)"""
)
_GAP = re.compile(r"\s*([>,+~])\s*|\s+")
_ESCAPE = re.compile(r"\\([0-9a-fA-F]{1,6})\s?|\\(.)")
_STEP = re.compile(r"([+-]?\d*)n\s*(?:([+-])\s*(\d+))?$|([+-]?\d+)$")
_PLACES = {"first-child": ("nth", 0, 1), "last-child": ("last", 0, 1)}


class SelectorError(ValueError):
    """The selector uses something outside the supported subset."""


def _unescaped(name: str | None) -> str | None:
    return name and _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else m[2], name)


def _argument(text: str, pos: int) -> tuple[str, int]:
    """What stands in the parentheses that open at ``pos``, and the place after them."""
    depth = 0
    for i in range(pos, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return text[pos + 1 : i].strip(), i + 1
    raise SelectorError(f"Unclosed parenthesis in {text!r}")


def _nth(argument: str) -> tuple[int, int]:
    """``an+b`` as (a, b)."""
    word = {"odd": "2n+1", "even": "2n"}.get(argument.lower(), argument.lower())
    m = _STEP.match(word)
    if not m:
        raise SelectorError(f"Unsupported place: {argument!r}")
    if m[4]:
        return 0, int(m[4])
    a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    return a, int((m[2] or "+") + (m[3] or "0"))


def _pseudo(name: str, text: str, pos: int) -> tuple[dict, int]:
    if name in _PLACES:
        return {"place": _PLACES[name]}, pos
    if name == "only-child":
        return {"place": ("only", 0, 1)}, pos
    if pos < len(text) and text[pos] == "(":
        argument, pos = _argument(text, pos)
        if name in ("nth-child", "nth-last-child"):
            return {"place": ("nth" if name == "nth-child" else "last", *_nth(argument))}, pos
        if name in ("not", "has", "is"):
            inner = _parse(argument)
            if any(len(steps) > 1 for steps in inner):
                raise SelectorError(f"Combinators are not allowed in :{name}()")
            return {name: [steps[0][1] for steps in inner]}, pos
    raise SelectorError(f"Unsupported selector: {text!r} at :{name}")


def _parse(selector: str) -> list[list[tuple[str, list[dict]]]]:
    """Alternatives, each a list of (combinator, simple selectors)."""
    text = selector.strip()
    alternatives: list = [[]]
    combinator, pos = "", 0
    compound: list[dict] = []
    while True:
        gap = _GAP.match(text, pos)
        if gap or pos >= len(text):
            if not compound:
                raise SelectorError(f"Unsupported selector: {selector!r}")
            alternatives[-1].append((combinator, compound))
            compound = []
            if pos >= len(text):
                return alternatives
            combinator = gap.group(1) or " "
            if combinator == ",":
                alternatives.append([])
                combinator = ""
            pos = gap.end()
            continue
        part = _SIMPLE.match(text, pos)
        if not part:
            raise SelectorError(f"Unsupported selector: {selector!r} at {text[pos:]!r}")
        found = part.groupdict()
        pos = part.end()
        if found["pseudo"]:
            found, pos = _pseudo(found["pseudo"], text, pos)
        else:
            found = {k: _unescaped(v) if k in ("type", "cls", "id", "attr", "bare") else v for k, v in found.items()}
        compound.append(found)


def _at_place(node: Column, kind: str, a: int, b: int) -> Column:
    if kind == "only":
        return node["siblings"] == 1
    n = node["nth"] if kind == "nth" else node["siblings"] - node["nth"] + 1
    if a == 0:
        return n == b
    return ((n - b) % a == 0) & ((n - b) * (1 if a > 0 else -1) >= 0)


def _simple(node: Column, part: dict, below: dict[int, Column]) -> Column:
    """``below``: for each ``:has()``, by the identity of its part, the ids that ``_next_ids`` gives."""
    if "place" in part:
        return _at_place(node, *part["place"])
    if "not" in part or "is" in part:
        held = reduce(lambda a, b: a | b, [_compound(node, p, below) for p in part.get("not") or part["is"]])
        return ~held if "not" in part else held
    if "has" in part:
        if id(part) not in below:
            raise SelectorError(":has() is not allowed here")
        return F.get(below[id(part)], node["id"]) <= node["stop_id"]
    if part["type"]:
        return F.lit(True) if part["type"] == "*" else node["tag"] == part["type"].lower()
    if part["cls"]:
        return F.array_contains(node["classes"], part["cls"])
    if part["id"]:
        return F.coalesce(F.try_element_at(node["attrs"], F.lit("id")) == part["id"], F.lit(False))
    attr = F.try_element_at(node["attrs"], F.lit(part["attr"].lower()))
    if not part["op"]:
        return attr.isNotNull()
    value = next((part[k] for k in ("dq", "sq", "bare") if part[k] is not None), "")
    if part["op"] == "~=":
        test = F.array_contains(F.split(attr, r"\s+"), value)
    elif part["op"] == "|=":
        test = (attr == value) | attr.startswith(value + "-")
    elif value == "" and part["op"] != "=":
        return F.lit(False)
    else:
        test = {
            "=": lambda: attr == value,
            "*=": lambda: attr.contains(value),
            "^=": lambda: attr.startswith(value),
            "$=": lambda: attr.endswith(value),
        }[part["op"]]()
    return F.coalesce(test, F.lit(False))


def _compound(node: Column, parts: list[dict], below: dict[int, Column] | None = None) -> Column:
    return reduce(lambda a, b: a & b, [_simple(node, p, below or {}) for p in parts])


def _looks_below(parts: list[dict]) -> list[dict]:
    """The ``:has()`` among ``parts``, also inside ``:not()`` and ``:is()``."""
    own = [p for p in parts if "has" in p]
    return own + [q for p in parts for k in ("not", "is") for compound in p.get(k) or [] for q in _looks_below(compound)]


def is_local(selector: str) -> bool:
    """No combinator and no look below: the element alone decides."""
    return all(len(steps) == 1 and not _looks_below(steps[0][1]) for steps in _parse(selector))


def node_predicate(selector: str) -> Callable[[Column], Column]:
    """Predicate on one element, for selectors without combinators."""
    alternatives = _parse(selector)
    if any(len(steps) > 1 for steps in alternatives):
        raise SelectorError(f"Combinators are not allowed here: {selector!r}")
    return lambda node: reduce(lambda a, b: a | b, [_compound(node, s[0][1]) for s in alternatives])


# ------------------------------------------------------------------ structure of a page

NONE = (1 << 31) - 1


def next_ids(found: Column, size: Column) -> Column:
    """For every place of a page of ``size`` elements, the first of the sorted ids ``found`` after it, or NONE."""

    def run(i: Column) -> Column:
        start = F.coalesce(F.get(found, i - 1), F.lit(0))
        return F.array_repeat(F.coalesce(F.get(found, i), F.lit(NONE)), F.coalesce(F.get(found, i), size) - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(found)), run))


def _reached(held: Column, links: Column) -> Column:
    """Whether following ``links`` from an element, once or more, comes to one that ``held`` marks.

    Both are arrays by id; a link below 0 ends. Every round follows twice as many
    links, until none leads further.
    """

    def further(state: Column, _: Column) -> Column:
        marks, ups = state["marks"], state["ups"]
        now = F.struct(
            F.transform(marks, lambda m, i: m | F.coalesce(F.get(marks, F.get(ups, i)), F.lit(False))).alias("marks"),
            F.transform(ups, lambda u: F.coalesce(F.get(ups, u), F.lit(-1))).alias("ups"),
        )
        return F.when(F.exists(ups, lambda u: u >= 0), now).otherwise(state)

    first = F.struct(F.transform(links, lambda u: F.coalesce(F.get(held, u), F.lit(False))).alias("marks"), links.alias("ups"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(links) + F.lit(2))).cast("int"))
    return F.aggregate(rounds, first, further, lambda state: state["marks"])


def _ids(marked: Column) -> Column:
    return F.filter(F.transform(marked, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())


def _either(one: Column, other: Column) -> Column:
    return let(F.struct(one.alias("a"), other.alias("b")), lambda x: F.transform(x["a"], lambda m, i: m | F.get(x["b"], i)))


def _by_hop(tree: Column, hop: str, held: Column, test: Callable[[Column], Column]) -> Column:
    """Flags of the elements that ``test`` holds for and that ``hop`` leads to from one of ``held``."""
    if hop in (">", "+"):
        link = "parent" if hop == ">" else "previous"
        return F.transform(tree, lambda n: F.coalesce(F.get(held, n[link]), F.lit(False)) & test(n))
    links = F.transform(tree, lambda n: n["parent" if hop == " " else "previous"])
    return let(let(links, lambda up: _reached(held, up)), lambda marks: F.transform(tree, lambda n: F.get(marks, n["id"]) & test(n)))


# ------------------------------------------------------------------ selectors of the plan

Steps = list[tuple[str, list[dict]]]  # (how the element is reached from the one before, its simple selectors)


def _with_below(tree: Column, parts: list[dict], body: Callable[[dict[int, Column]], Column], held: dict[int, Column] | None = None) -> Column:
    """``body`` with what each ``:has()`` of ``parts`` needs, bound once for the page."""
    held = held or {}
    todo = [p for p in _looks_below(parts) if id(p) not in held]
    if not todo:
        return body(held)
    part = todo[0]
    inner = [q for compound in part["has"] for q in compound]
    found = _with_below(
        tree, inner,
        lambda below: F.transform(F.filter(tree, lambda n: reduce(lambda a, b: a | b, [_compound(n, p, below) for p in part["has"]])), lambda n: n["id"]),
    )
    after = let(found, lambda ids: next_ids(ids, F.size(tree)))
    return let(after, lambda ids: _with_below(tree, parts, body, {**held, id(part): ids}))


def _holding(tree: Column, steps: Steps) -> Column:
    """Flags of the elements that end the chain ``steps``."""
    hop, parts = steps[-1]
    if len(steps) == 1:
        return _with_below(tree, parts, lambda below: F.transform(tree, lambda n: _compound(n, parts, below)))
    return let(
        _holding(tree, steps[:-1]),
        lambda held: _with_below(tree, parts, lambda below: _by_hop(tree, hop, held, lambda n: _compound(n, parts, below))),
    )


def match_ids(tree: Column, selector: str) -> Column:
    """Ids of the matching elements, in document order."""
    alternatives = _parse(selector)
    if is_local(selector):
        return F.transform(F.filter(tree, node_predicate(selector)), lambda n: n["id"])
    marks = _holding(tree, alternatives[0])
    for steps in alternatives[1:]:
        marks = _either(marks, _holding(tree, steps))
    return let(marks, _ids)


def match_nodes(tree: Column, selector: str) -> Column:
    """The matching elements themselves, in document order."""
    if is_local(selector):
        return F.filter(tree, node_predicate(selector))
    return F.transform(match_ids(tree, selector), lambda i: dom.node_at(tree, i))


# ------------------------------------------------------------------ selectors as data

_DATA = "kind: string, name: string, op: string, value: string, a: int, b: int"
PLAN = f"array<array<struct<hop: string, parts: array<struct<{_DATA}, inner: array<array<struct<{_DATA}>>>>>>>>"
_FIELDS = [("kind", pa.string()), ("name", pa.string()), ("op", pa.string()), ("value", pa.string()), ("a", pa.int32()), ("b", pa.int32())]
_INNER = pa.list_(pa.list_(pa.struct(_FIELDS)))
ARROW_PLAN = pa.list_(pa.list_(pa.struct([("hop", pa.string()), ("parts", pa.list_(pa.struct([*_FIELDS, ("inner", _INNER)])))])))


def _as_data(part: dict, inside: bool = False) -> dict:
    row = {"kind": "", "name": "", "op": "", "value": "", "a": 0, "b": 0}
    for kind in ("not", "is", "has"):
        if kind in part:
            if inside:
                raise SelectorError(f":{kind}() is not allowed inside another one")
            return row | {"kind": kind, "inner": [[_as_data(p, True) for p in compound] for compound in part[kind]]}
    more = {} if inside else {"inner": []}
    if "place" in part:
        kind, a, b = part["place"]
        return row | more | {"kind": "place", "name": kind, "a": a, "b": b}
    if part["type"]:
        return row | more | {"kind": "type", "name": part["type"].lower()}
    if part["cls"]:
        return row | more | {"kind": "class", "name": part["cls"]}
    if part["id"]:
        return row | more | {"kind": "attr", "name": "id", "op": "=", "value": part["id"]}
    value = next((part[k] for k in ("dq", "sq", "bare") if part[k] is not None), "")
    return row | more | {"kind": "attr", "name": part["attr"].lower(), "op": part["op"] or "", "value": value}


def plan(selector: str) -> list[list[dict]]:
    """A selector as rows of ``PLAN``. ``:not() :is() :has()`` may not stand in each other."""
    return [[{"hop": hop, "parts": [_as_data(p) for p in parts]} for hop, parts in steps] for steps in _parse(selector)]


def literal(value: object, kind: str) -> Column:
    """Nested data as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def with_plans(selectors: DataFrame) -> DataFrame:
    """``selector, plan, problem`` of every row of ``selector``; a selector that can't be used has a null plan and says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans, problems = [], []
            for text in batch.column(0).to_pylist():
                try:
                    plans.append(plan(text))
                    problems.append(None)
                except SelectorError as error:
                    plans.append(None)
                    problems.append(str(error))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plans, ARROW_PLAN), pa.array(problems, pa.string())], names=["selector", "plan", "problem"])

    return selectors.select("selector").mapInArrow(run, f"selector string, plan {PLAN}, problem string")


def _place_by(node: Column, part: Column) -> Column:
    n = F.when(part["name"] == "last", node["siblings"] - node["nth"] + 1).otherwise(node["nth"])
    far = n - part["b"]
    repeated = F.when(part["a"] == 0, far == 0).otherwise((far % part["a"] == 0) & (far * F.signum(part["a"]) >= 0))
    return F.when(part["name"] == "only", node["siblings"] == 1).otherwise(repeated)


def _attribute_by(value: Column, part: Column) -> Column:
    op, want = part["op"], part["value"]
    test = (
        F.when(op == "", value.isNotNull())
        .when(op == "=", value == want)
        .when(op == "|=", (value == want) | F.startswith(value, F.concat(want, F.lit("-"))))
        .when(op == "~=", F.array_contains(F.split(value, r"\s+"), want))
        .when(want == "", F.lit(False))
        .when(op == "*=", F.contains(value, want))
        .when(op == "^=", F.startswith(value, want))
        .otherwise(F.endswith(value, want))
    )
    return F.coalesce(test, F.lit(False))


def _simple_by(node: Column, part: Column) -> Column:
    return (
        F.when(part["kind"] == "class", F.array_contains(node["classes"], part["name"]))
        .when(part["kind"] == "type", (part["name"] == "*") | (node["tag"] == part["name"]))
        .when(part["kind"] == "attr", _attribute_by(F.try_element_at(node["attrs"], part["name"]), part))
        .otherwise(_place_by(node, part))
    )


def _inner_by(node: Column, part: Column) -> Column:
    return F.exists(part["inner"], lambda compound: F.forall(compound, lambda p: _simple_by(node, p)))


def _flags_by(tree: Column, parts: Column) -> Column:
    """Flags of the elements that all of ``parts`` hold for."""

    def after(part: Column) -> Column:
        found = F.transform(F.filter(tree, lambda n: _inner_by(n, part)), lambda n: n["id"])
        return F.when(part["kind"] == "has", let(found, lambda ids: next_ids(ids, F.size(tree))))

    def holds(node: Column, x: Column) -> Column:
        part = x["part"]
        return (
            F.when(part["kind"] == "has", F.get(x["after"], node["id"]) <= node["stop_id"])
            .when(part["kind"] == "not", ~_inner_by(node, part))
            .when(part["kind"] == "is", _inner_by(node, part))
            .otherwise(_simple_by(node, part))
        )

    ready = F.transform(parts, lambda p: F.struct(p.alias("part"), after(p).alias("after")))
    return let(ready, lambda xs: F.transform(tree, lambda n: F.forall(xs, lambda x: holds(n, x))))


def _marks_by(tree: Column, steps: Column) -> Column:
    def step(held: Column, s: Column) -> Column:
        def joined(own: Column) -> Column:
            def linked(link: str) -> Column:
                return F.transform(own, lambda m, i: m & F.coalesce(F.get(held, dom.node_at(tree, i)[link]), F.lit(False)))

            def reached(link: str) -> Column:
                marks = let(F.transform(tree, lambda n: n[link]), lambda up: _reached(held, up))
                return let(marks, lambda r: F.transform(own, lambda m, i: m & F.get(r, i)))

            return (
                F.when(s["hop"] == "", own).when(s["hop"] == ">", linked("parent")).when(s["hop"] == "+", linked("previous"))
                .when(s["hop"] == " ", reached("parent")).otherwise(reached("previous"))
            )

        return let(_flags_by(tree, s["parts"]), joined)

    return F.aggregate(steps, F.lit(None).cast("array<boolean>"), step)


def match_ids_by(tree: Column, plan_: Column) -> Column:
    """Ids of the elements that match the selector in ``plan_``, a column of ``PLAN``; null where that is null."""
    marks = F.transform(plan_, lambda steps: _marks_by(tree, steps))
    ids = let(marks, lambda each: F.filter(F.transform(tree, lambda n: F.when(F.exists(each, lambda m: F.get(m, n["id"])), n["id"])), lambda i: i.isNotNull()))
    return F.when(plan_.isNotNull(), ids)


def selector_match(pages: DataFrame, selector: str | Column) -> DataFrame:
    """One row per matching element of every page. ``selector`` is one for all pages, or a column of ``PLAN``."""
    if isinstance(selector, str):
        parsed = dom.parse(pages.select("page_id", "html"))
        nodes = match_nodes(F.col("nodes"), selector)
    else:
        parsed = dom.parse(pages.select("page_id", "html", selector.alias("_plan")))
        nodes = F.transform(match_ids_by(F.col("nodes"), F.col("_plan")), lambda i: dom.node_at(F.col("nodes"), i))
    hits = F.transform(
        nodes,
        lambda n: F.struct(
            n["id"].alias("node_id"),
            n["tag"].alias("tag"),
            dom.text_of(F.col("content"), n).alias("text"),
        ),
    )
    return unnest(parsed, ["page_id"], hits, "pos")
