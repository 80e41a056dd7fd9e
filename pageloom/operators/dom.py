"""HTML to element tables.

``parse`` is the one place where Python runs inside the tasks. It is a narrow
map: one row in, one row out, no shuffle. The tree of a page comes back as an
array of element structs in document order (a nested set), so that

* the descendants of element ``n`` are the slice ``n.id + 1 .. n.stop_id``;
* its text is one byte range of the page's text;
* "holds a link" or "holds an image" is the difference of two counters.

Everything built on top uses native array expressions on that row and therefore
stays in the scan stage, however many pages there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.base import let

NODE = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("stop_id", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text_from", T.IntegerType()),
        T.StructField("text_to", T.IntegerType()),
        T.StructField("src_from", T.IntegerType()),
        T.StructField("src_to", T.IntegerType()),
        T.StructField("links_seen", T.IntegerType()),
        T.StructField("images_seen", T.IntegerType()),
        T.StructField("nth", T.IntegerType()),  # place among its siblings, from 1
        T.StructField("siblings", T.IntegerType()),  # how many there are, itself included
        T.StructField("previous", T.IntegerType()),  # the sibling before it, or -1
    ]
)
_ARROW_NODE = pa.struct(
    [
        ("id", pa.int32()),
        ("parent", pa.int32()),
        ("stop_id", pa.int32()),
        ("tag", pa.string()),
        ("classes", pa.list_(pa.string())),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("text_from", pa.int32()),
        ("text_to", pa.int32()),
        ("src_from", pa.int32()),
        ("src_to", pa.int32()),
        ("links_seen", pa.int32()),
        ("images_seen", pa.int32()),
        ("nth", pa.int32()),
        ("siblings", pa.int32()),
        ("previous", pa.int32()),
    ]
)

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>",
    re.S,
)
_ATTR = re.compile(
    r"""([^\s=>/][^\s=>/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?"""
)

# Element groups of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes noscript".split())  # noscript: as with scripts on
_RCDATA = frozenset("title textarea".split())
_HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p "
    "pre section summary table ul".split()
)
_SPECIAL = _ENDS_P | frozenset(
    "applet body button caption col colgroup head html iframe marquee object select tbody td "
    "template tfoot th thead tr script style title textarea".split()
)
_SCOPE = frozenset("applet caption html table td th marquee object template".split())
_TABLE_PARTS = {
    "caption": ("table",),
    "colgroup": ("table",),
    "tbody": ("table",),
    "thead": ("table",),
    "tfoot": ("table",),
    "tr": ("tbody", "thead", "tfoot", "table"),
    "td": ("tr", "tbody", "thead", "tfoot", "table"),
    "th": ("tr", "tbody", "thead", "tfoot", "table"),
}
# Browsers do not nest deeper than this; deeper elements become siblings.
_MAX_DEPTH = 512


class _Tree:
    """Open-element stack that applies the implied start and end tags."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.stack: list[int] = []
        self.names: list[str] = []
        self.text: list[bytes] = []
        self.size = self.links = self.images = 0
        self.head_done = self.in_body = False

    def push(self, tag: str, attrs: dict, at: int, to: int, leaf: bool = False) -> None:
        if len(self.stack) >= _MAX_DEPTH:
            self.pop(at)
        node = len(self.rows)
        self.links += tag == "a" and "href" in attrs
        self.images += tag == "img"
        parent = self.stack[-1] if self.stack else -1
        self.rows.append([parent, node, tag, attrs, self.size, self.size, at, to, self.links, self.images])
        if not leaf:
            self.stack.append(node)
            self.names.append(tag)

    def pop(self, at: int) -> None:
        row = self.rows[self.stack.pop()]
        self.names.pop()
        row[1], row[5], row[7] = len(self.rows) - 1, self.size, at

    def pop_to(self, depth: int, at: int, after: int | None = None) -> None:
        """Close everything above ``depth``, and that element too."""
        while len(self.stack) > depth + 1:
            self.pop(at)
        self.pop(at if after is None else after)

    def find(self, wanted, barrier) -> int:
        """Depth of the innermost open ``wanted`` this side of ``barrier``."""
        for depth in range(len(self.names) - 1, -1, -1):
            if self.names[depth] in wanted:
                return depth
            if self.names[depth] in barrier:
                break
        return -1

    def add_text(self, data: str) -> None:
        raw = data.encode("utf-8", "replace")
        self.text.append(raw)
        self.size += len(raw)

    def need_html(self, at: int) -> None:
        if not self.rows:
            self.push("html", {}, at, at)

    def need_body(self, at: int) -> None:
        self.need_html(at)
        if not self.in_body:
            self.need_head(at)
            while len(self.stack) > 1:
                self.pop(at)
            self.push("body", {}, at, at)
            self.in_body = True

    def need_head(self, at: int) -> None:
        self.need_html(at)
        if not self.head_done:
            self.push("head", {}, at, at)
            self.head_done = True

    def characters(self, data: str, at: int) -> None:
        if not self.in_body and (len(self.stack) < 3):
            if not data.strip():
                return
            self.need_body(at)
        self.add_text(data)

    def start(self, tag: str, attrs: dict, self_closing: bool, at: int, to: int) -> bool:
        """Open an element; false when the tag is to be ignored."""
        if tag == "html":
            if self.rows:
                for key, value in attrs.items():
                    self.rows[0][3].setdefault(key, value)
            else:
                self.push("html", attrs, at, to)
            return False
        if tag == "head":
            self.need_html(at)
            if not self.head_done:
                self.push("head", attrs, at, to)
                self.head_done = True
            return False
        if tag == "body":
            if not self.in_body:
                self.need_head(at)
                while len(self.stack) > 1:
                    self.pop(at)
                self.push("body", attrs, at, to)
                self.in_body = True
            return False
        if not self.in_body:
            if tag in _HEAD_ONLY and (not self.head_done or len(self.stack) > 1):
                self.need_head(at)
            elif not (len(self.stack) > 2):
                self.need_body(at)
        if tag in _ENDS_P:
            open_p = self.find(("p",), _SCOPE | {"button"})
            if open_p >= 0:
                self.pop_to(open_p, at)
        if tag == "li":
            self._close_like(("li",), at)
        elif tag in ("dd", "dt"):
            self._close_like(("dd", "dt"), at)
        elif tag in _HEADINGS and self.names[-1] in _HEADINGS:
            self.pop(at)
        elif tag in ("option", "optgroup") and self.names[-1] == "option":
            self.pop(at)
        elif tag in ("a", "button"):
            again = self.find((tag,), _SCOPE)
            if again >= 0:
                self.pop_to(again, at)
        elif tag in _TABLE_PARTS and not self._table_context(tag, at):
            return False
        foreign_leaf = self_closing and ("svg" in self.names or "math" in self.names or tag in ("svg", "math"))
        self.push(tag, attrs, at, to, leaf=tag in _VOID or foreign_leaf)
        return not (tag in _VOID or foreign_leaf)

    def _close_like(self, names, at: int) -> None:
        for depth in range(len(self.names) - 1, -1, -1):
            name = self.names[depth]
            if name in names:
                self.pop_to(depth, at)
                return
            if name in _SPECIAL and name not in ("address", "div", "p"):
                return

    def _table_context(self, tag: str, at: int) -> bool:
        """Close open cells and rows, add the missing section or row."""
        depth = self.find(_TABLE_PARTS[tag], ("template", "html"))
        if depth < 0:
            return False
        while len(self.stack) > depth + 1:
            self.pop(at)
        if tag in ("tr", "td", "th") and self.names[-1] == "table":
            self.push("tbody", {}, at, at)
        if tag in ("td", "th") and self.names[-1] != "tr":
            self.push("tr", {}, at, at)
        return True

    def end(self, tag: str, at: int, to: int) -> None:
        if tag == "br":
            self.need_body(at)
            self.push("br", {}, at, to, leaf=True)
            return
        if tag == "head":
            if self.names[-1:] == ["head"]:
                self.pop(to)
            return
        if tag in ("html", "body"):
            return
        if tag in _HEADINGS:
            depth = self.find(_HEADINGS, _SCOPE)
        elif tag == "p":
            depth = self.find(("p",), _SCOPE | {"button"})
            if depth < 0:
                self.need_body(at)
                self.push("p", {}, at, to, leaf=True)
                return
        elif tag == "li":
            depth = self.find(("li",), _SCOPE | {"ul", "ol"})
        elif tag in _TABLE_PARTS or tag == "table":
            depth = self.find((tag,), ("table",) if tag != "table" else ("html",))
        elif tag in _SPECIAL:
            depth = self.find((tag,), _SCOPE)
        else:
            depth = self.find((tag,), _SPECIAL)
        if depth >= 0:
            self.pop_to(depth, at, to)


_TEMPLATE = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)template(?=[\s/>])[^>]*+>", re.S | re.I)


def _template_end(html: str, at: int) -> int:
    """Where the template that was opened before ``at`` ends, inner ones skipped."""
    depth = 1
    for match in _TEMPLATE.finditer(html, at):
        if match.group(1) is not None:
            depth += -1 if match.group(1) else 1
            if depth == 0:
                return match.end()
    return len(html)


def build_tree(html: str) -> tuple[list[list], bytes]:
    """Rows (parent, stop_id, tag, attrs, text range, source range, counters) and text."""
    tree = _Tree()
    at, end = 0, len(html)
    while at < end:
        match = _TOKEN.search(html, at)
        upto = match.start() if match else end
        if upto > at:
            data = html[at:upto]
            tree.characters(unescape(data) if "&" in data else data, at)
        if not match:
            break
        at = match.end()
        name = match.group(2)
        if not name:
            continue
        tag = name.lower()
        if match.group(1):
            tree.end(tag, upto, at)
            continue
        attrs: dict[str, str] = {}
        rest = match.group(3)
        for key, double, single, bare in _ATTR.findall(rest):
            value = double or single or bare
            attrs.setdefault(key.lower(), unescape(value) if "&" in value else value)
        if not tree.start(tag, attrs, rest.endswith("/"), upto, at):
            continue
        if tag == "template":  # its content is no part of the page
            at = _template_end(html, at)
            tree.pop(at)
        elif tag in _RAW or tag in _RCDATA:
            closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(html, at)
            stop = closing.start() if closing else end
            data = html[at:stop]
            tree.add_text(unescape(data) if tag in _RCDATA and "&" in data else data)
            at = closing.end() if closing else end
            tree.pop(at)
    tree.need_body(end)
    while tree.stack:
        tree.pop(end)
    return tree.rows, b"".join(tree.text)


def _places(rows: list[list]) -> tuple[list[int], list[int], list[int]]:
    """Of each element: place among its siblings, their number, and the one before."""
    last: dict[int, int] = {}
    count: dict[int, int] = {}
    nth, previous = [], []
    for i, row in enumerate(rows):
        parent = row[0]
        count[parent] = count.get(parent, 0) + 1
        nth.append(count[parent])
        previous.append(last.get(parent, -1))
        last[parent] = i
    return nth, [count[row[0]] for row in rows], previous


def _nodes_array(pages: list[list[list]]) -> pa.Array:
    """One list of element structs per page, built column by column."""
    offsets, ids, flat = [0], [], []
    for rows in pages:
        ids.extend(range(len(rows)))
        flat.extend(rows)
        offsets.append(len(ids))
    ints = list(zip(*[(r[0], r[1], r[4], r[5], r[6], r[7], r[8], r[9]) for r in flat])) or [()] * 8
    i32 = [pa.array(c, pa.int32()) for c in ints]
    classes = pa.array([r[3].get("class", "").split() for r in flat], pa.list_(pa.string()))
    attrs = pa.array([list(r[3].items()) for r in flat], pa.map_(pa.string(), pa.string()))
    tags = pa.array([r[2] for r in flat], pa.string())
    columns = [pa.array(ids, pa.int32()), i32[0], i32[1], tags, classes, attrs, *i32[2:]]
    places = [_places(rows) for rows in pages]
    columns += [pa.array([v for p in places for v in p[k]], pa.int32()) for k in range(3)]
    struct = pa.StructArray.from_arrays(columns, fields=list(_ARROW_NODE))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)


# Output is handed on whenever this much markup has been parsed, so memory does
# not grow with the number of rows per Arrow batch.
_CHUNK_CHARS = 4_000_000


def parse(pages: DataFrame, keep_html: bool = False) -> DataFrame:
    """Add ``nodes`` and ``content`` (the page's text, UTF-8) in place of ``html``."""
    kept = [f for f in pages.schema.fields if keep_html or f.name != "html"]
    names = [f.name for f in kept]
    schema = T.StructType(
        [*kept, T.StructField("content", T.BinaryType()), T.StructField("nodes", T.ArrayType(NODE))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html")
            start = 0
            trees: list[list[list]] = []
            texts: list[bytes] = []
            chars = 0
            for row in range(batch.num_rows):
                source = html[row].as_py() or ""
                rows, text = build_tree(source)
                trees.append(rows)
                texts.append(text)
                chars += len(source)
                if chars >= _CHUNK_CHARS or row == batch.num_rows - 1:
                    part = batch.slice(start, row + 1 - start)
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(n) for n in names], pa.array(texts, pa.binary()), _nodes_array(trees)],
                        names=[*names, "content", "nodes"],
                    )
                    start, trees, texts, chars = row + 1, [], [], 0

    return pages.mapInArrow(run, schema)


def nodes(pages: DataFrame) -> DataFrame:
    """One row per element."""
    return parse(pages.select("page_id", "html")).select("page_id", F.inline("nodes"))


# ------------------------------------------------------------------ reading a tree


def node_at(tree: Column, node_id: Column) -> Column:
    return F.get(tree, node_id)


def subtree(tree: Column, node: Column) -> Column:
    """The descendants of ``node``."""
    return F.slice(tree, node["id"] + 2, node["stop_id"] - node["id"])


def byte_range(content: Column, start: Column, stop: Column) -> Column:
    return F.substring(content, start + 1, stop - start).cast("string")


def text_of(content: Column, node: Column) -> Column:
    """Text content of ``node``, as found in the markup."""
    return byte_range(content, node["text_from"], node["text_to"])


def hidden_ranges(tree: Column, tags: tuple[str, ...] = ("script", "style", "noscript")) -> Column:
    return F.transform(
        F.filter(tree, lambda n: n["tag"].isin(*tags) & (n["text_to"] > n["text_from"])),
        lambda n: F.struct(n["text_from"].alias("a"), n["text_to"].alias("b")),
    )


def visible_text_of(content: Column, node: Column, hidden: Column) -> Column:
    """Text content of ``node`` without the ``hidden`` ranges inside it."""
    start, stop = node["text_from"], node["text_to"]

    def around(inside: Column) -> Column:
        count = F.size(inside)
        return F.array_join(
            F.transform(
                F.sequence(F.lit(0), count),
                lambda i: byte_range(
                    content,
                    F.when(i == 0, start).otherwise(F.get(inside, i - 1)["b"]),
                    F.when(i == count, stop).otherwise(F.get(inside, i)["a"]),
                ),
            ),
            "",
        )

    return let(
        F.filter(hidden, lambda h: (h["a"] >= start) & (h["b"] <= stop)),
        lambda inside: F.when(F.size(inside) == 0, byte_range(content, start, stop)).otherwise(around(inside)),
    )


def is_link(node: Column) -> Column:
    return (node["tag"] == "a") & F.map_contains_key(node["attrs"], "href")


def holds_link(tree: Column, node: Column) -> Column:
    """A link strictly inside ``node``."""
    return node_at(tree, node["stop_id"])["links_seen"] > node["links_seen"]


def holds_image(tree: Column, node: Column) -> Column:
    return node_at(tree, node["stop_id"])["images_seen"] > node["images_seen"]
