"""Rows of repeated elements: products, search hits, table rows.

Extraction is narrow. Each matched element is exploded together with its own
descendants and its own bytes of text, so a page's tree is not copied per row.
Only de-duplication and caps look across pages.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from pageloom.functions import media, prices, urls
from pageloom.functions import text as tx
from pageloom.functions.base import built, first_of, let, select_where, unnest
from pageloom.operators import dom, select

# Selectors tried, in order, when none is given.
AUTO_SELECTORS = (
    "[data-product-id]",
    "[itemtype*='Product']",
    "li.product",
    ".product-item",
    ".product-card",
    ".product",
    "article.product",
    ".card",
    ".listing-item",
    "[class*='product-list'] > *",
    "[class*='ProductCard']",
    "ul.products > li",
    "table tbody tr",
    "article",
    ".item",
)
# Where the title and the price of an item are looked for.
TITLE_SELECTOR = "h1, h2, h3, h4, h5, .title, [class*='title'], [class*='name'], a[title]"
PRICE_SELECTOR = "[class*='price'], [itemprop='price'], .amount, bdi"
MIN_MATCHES = 3
NO_LIMIT = (1 << 62) - 1

GENERIC = ("title", "price", "price_value", "currency", "link", "image", "text")


# ------------------------------------------------------------------ detection


def _meaningful(tree: Column, content: Column, node: Column) -> Column:
    def judge(text: Column) -> Column:
        return (F.length(text) >= 3) & (
            dom.holds_link(tree, node)
            | dom.holds_image(tree, node)
            | (node["tag"] == "tr")
            | text.rlike(prices.PRICE)
        )

    return let(tx.collapse(dom.text_of(content, node)), judge)


@built
def known_plans() -> Column:
    """The known selectors as data, in the order they are tried."""
    return select.literal([{"selector": s, "plan": select.plan(s)} for s in AUTO_SELECTORS], f"array<struct<selector: string, plan: {select.PLAN}>>")


@built
def detected(sample: int | None = None) -> Column:
    """Best of the known selectors: ``struct<order, rank, selector, matches, meaningful, score>`` or null.

    Every match is judged, or the first ``sample``; a browser tool would look at 40.
    Of a table with ``nodes`` and ``content``.
    """
    tree, content = F.col("nodes"), F.col("content")

    def score(known: Column, rank: Column) -> Column:
        def judge(ids: Column) -> Column:
            looked_at = first_of(ids, sample)
            good = F.size(
                F.filter(looked_at, lambda i: let(dom.node_at(tree, i), lambda n: _meaningful(tree, content, n)))
            )
            value = good / F.size(looked_at) * F.log10(F.size(ids) + F.lit(1)) * 100
            return F.when(
                (F.size(ids) >= MIN_MATCHES),
                F.struct(
                    (-value).alias("order"),
                    rank.alias("rank"),
                    known["selector"].alias("selector"),
                    F.size(ids).alias("matches"),
                    good.alias("meaningful"),
                    value.alias("score"),
                ),
            )

        return let(select.match_ids_by(tree, known["plan"]), judge)

    scored = F.transform(known_plans(), score)
    usable = F.filter(scored, lambda s: s.isNotNull() & (s["meaningful"] >= MIN_MATCHES))
    return F.get(F.array_sort(usable), F.lit(0))


def detect_selectors(pages: DataFrame, sample: int | None = None) -> DataFrame:
    """``page_id, selector, matches, score``; a null selector where none fits."""
    parsed = dom.parse(pages.select("page_id", "html"))
    best = parsed.select("page_id", detected(sample).alias("best"))
    return best.select("page_id", "best.selector", "best.matches", "best.score")


# ------------------------------------------------------------------ one element


def _table_headers(tree: Column, content: Column) -> Column:
    """Header texts of every table: ``array<struct<id, stop_id, headers>>``."""

    def header_cells(sub: Column) -> Column:
        heads = F.filter(sub, lambda n: n["tag"] == "thead")
        in_head = let(
            heads,
            lambda hs: F.filter(
                sub,
                lambda n: (n["tag"] == "tr")
                & F.exists(hs, lambda h: (h["id"] < n["id"]) & (n["id"] <= h["stop_id"])),
            ),
        )
        head_row = F.get(in_head, F.lit(0))
        first_row = F.get(F.filter(sub, lambda n: n["tag"] == "tr"), F.lit(0))

        def cells(row: Column, *tags: str) -> Column:
            return F.coalesce(
                F.filter(dom.subtree(tree, row), lambda n: n["tag"].isin(*tags)),
                F.array().cast(T.ArrayType(dom.NODE)),
            )

        return let(
            let(head_row, lambda r: cells(r, "th", "td")),
            lambda found: F.when(F.size(found) > 0, found).otherwise(let(first_row, lambda r: cells(r, "th"))),
        )

    return F.transform(
        F.filter(tree, lambda n: n["tag"] == "table"),
        lambda t: F.struct(
            t["id"],
            t["stop_id"],
            F.transform(
                let(dom.subtree(tree, t), header_cells),
                lambda c: tx.collapse(dom.text_of(content, c)),
            ).alias("headers"),
        ),
    )


@built
def _items(tables: bool, outer: bool) -> Column:
    """The elements ``ids`` names, each with its descendants, text, table headers, and what its fields hit.

    ``hits`` are places among the descendants, one for each of ``specs``. With
    ``outer`` a page without matches has one null.
    """
    tree, content = F.col("nodes"), F.col("content")
    # For each field with a selector, and each element, the next match on the page.
    after = F.transform("specs", lambda f: F.when(f["plan"].isNotNull(), let(select.match_ids_by(tree, f["plan"]), lambda ids: select.next_ids(ids, F.size(tree)))))

    def hit(node: Column, following: Column) -> Column:
        return let(F.get(following, node["id"]), lambda i: F.when(i <= node["stop_id"], i - node["id"] - 1))

    def items(bound: Column) -> Column:
        def item(node: Column) -> Column:
            headers = F.lit(None).cast("array<string>")
            if tables:
                around = F.filter(
                    bound["tables"], lambda t: (t["id"] < node["id"]) & (node["id"] <= t["stop_id"])
                )
                headers = F.when(node["tag"] == "tr", F.try_element_at(around, F.lit(-1))["headers"])
            return F.struct(
                node.alias("me"),
                dom.subtree(tree, node).alias("sub"),
                F.substring(content, node["text_from"] + 1, node["text_to"] - node["text_from"]).alias("own"),
                headers.alias("headers"),
                F.transform(bound["after"], lambda following: hit(node, following)).alias("hits"),
            )

        return F.transform(F.transform("ids", lambda i: dom.node_at(tree, i)), item)

    found = _table_headers(tree, content) if tables else F.lit(None).cast("array<int>")
    every = let(F.struct(found.alias("tables"), after.alias("after")), items)
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.lit(None))) if outer else every


def explode_items(parsed: DataFrame, keys: list[str], tables: bool = True, outer: bool = False) -> DataFrame:
    """One row per matched element with all its extraction needs.

    ``parsed`` has url, nodes, content, ``ids`` of the elements and ``specs`` of fields,
    or null. Adds ``item_idx``, ``me`` (the element), ``sub`` (its descendants), ``own``
    (its text bytes), ``headers`` (of the table it is in), ``hits`` and ``base``.
    """
    return unnest(parsed, [*keys, "specs", _base()], _items(tables, outer), "item_idx")


@built
def _base() -> Column:
    return urls.base_parts(F.col("url")).alias("base")


def _text_in(node: Column) -> Column:
    """Text of an element of ``sub``, from the item's own bytes."""
    start = F.col("me")["text_from"]
    return dom.byte_range(F.col("own"), node["text_from"] - start, node["text_to"] - start)


def _first(selector: str) -> Column:
    return F.get(F.filter(F.col("sub"), select.node_predicate(selector)), F.lit(0))


def _attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def _image(own_tag: Column) -> Column:
    """Best image of an item: its ``img``, else a ``source``, else a background."""
    img = F.when(own_tag == "img", F.col("me")).otherwise(_first("img"))
    style = F.coalesce(_attr(F.col("me"), "style"), _attr(_first("[style*='background']"), "style"))
    background = rf"(?i)background(?:-image)?[{tx.WS}]*:[{tx.WS}]*{media.CSS_URL}"

    def candidate(is_set: bool, value: Column) -> Column:
        return F.struct(F.lit(is_set).alias("is_set"), value.alias("value"))

    from_img = let(
        img,
        lambda n: F.array(*[candidate("srcset" in a, _attr(n, a)) for a in media.IMAGE_ATTRS]),
    )
    rest = F.array(
        candidate(True, _attr(_first("source[srcset]"), "srcset")),
        candidate(False, F.regexp_extract(style, background, 2)),
    )
    present = F.filter(F.concat(from_img, rest), lambda c: c["value"] != "")
    resolved = F.transform(
        present,
        lambda c: urls.resolve(
            F.when(c["is_set"], media.srcset_best(c["value"])).otherwise(c["value"]), F.col("base")
        ),
    )
    return F.get(F.filter(resolved, lambda u: u.isNotNull()), F.lit(0))


@built
def _generic_inputs() -> list[Column]:
    me = F.col("me")
    return [
        tx.collapse(F.col("own").cast("string")).alias("_text"),
        tx.collapse(F.coalesce(_text_in(_first(TITLE_SELECTOR)), F.lit(""))).alias("_heading"),
        F.when(me["tag"] == "a", me).otherwise(_first("a[href]")).alias("_link"),
        tx.collapse(F.coalesce(_text_in(_first(PRICE_SELECTOR)), F.lit(""))).alias("_priced"),
        _image(me["tag"]).alias("image"),
    ]


@built
def _price_and_link() -> list[Column]:
    text = F.col("_text")
    in_price_node = prices.price_text(F.when(F.col("_priced") != "", F.col("_priced")).otherwise(text))
    return [
        tx.collapse(F.coalesce(in_price_node, prices.price_text(text))).alias("price"),
        urls.resolve(_attr(F.col("_link"), "href"), F.col("base")).alias("link"),
    ]


@built
def _generic() -> list[Column]:
    text = F.col("_text")
    first_line = F.get(F.split(text, "\n"), F.lit(0))
    return [
        F.coalesce(
            F.nullif("_heading", F.lit("")),
            F.nullif(_attr(F.col("_link"), "title"), F.lit("")),
            first_line,
        ).alias("title"),
        F.col("price"),
        prices.price_value(F.col("price")).alias("price_value"),
        prices.currency(F.col("price")).alias("currency"),
        F.col("link"),
        F.col("image"),
        text.alias("text"),
    ]


def generic_columns(items: DataFrame, keys: list[str], extra: list[str]) -> tuple[DataFrame, list[Column]]:
    """The seven columns every non-table item has, and the input they need.

    Texts are whole; a browser tool would cut them at 500 characters, and a
    title that is a first line at 200.
    """
    staged = items.select(*keys, "item_idx", *extra, "base", *_generic_inputs())
    return staged.select("*", *_price_and_link()), _generic()


@built
def _entries() -> Column:
    """The cells of a table row as names and values; null for other elements and for rows without any text."""
    is_row = (F.col("me")["tag"] == "tr") & F.col("specs").isNull()
    me, sub, headers = F.col("me"), F.col("sub"), F.col("headers")
    cells = F.filter(F.when(is_row, sub), lambda n: n["tag"].isin("td", "th"))

    def cell(node: Column, i: Column) -> Column:
        inside = F.slice(sub, node["id"] - me["id"] + 1, node["stop_id"] - node["id"])
        href = _attr(F.get(F.filter(inside, dom.is_link), F.lit(0)), "href")
        name = F.coalesce(
            F.nullif(F.get(headers, i), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))
        )
        return F.struct(
            name.alias("name"),
            tx.collapse(_text_in(node)).alias("value"),
            urls.resolve(href, F.col("base")).alias("href"),
        )

    def entries(c: Column) -> Column:
        own = F.array(F.struct(c["name"].alias("name"), c["value"].alias("value")))
        linked = F.array(F.struct(F.concat(c["name"], F.lit("_link")).alias("name"), c["href"].alias("value")))
        return F.when(c["href"].isNull(), own).otherwise(F.concat(own, linked))

    found = F.flatten(F.transform(F.transform(cells, cell), entries))
    return let(found, lambda es: F.when(F.exists(es, lambda e: e["value"] != ""), es)).alias("_entries")


@built
def _keys_and_values() -> list[Column]:
    names = F.array_distinct(F.transform("_entries", lambda e: e["name"]))
    # A repeated name keeps its first place and its last value.
    values = let(
        names,
        lambda ns: F.map_from_arrays(
            ns,
            F.transform(
                ns,
                lambda n: F.try_element_at(F.filter("_entries", lambda e: e["name"] == n), F.lit(-1))["value"],
            ),
        ),
    )
    return [names.alias("keys"), values.alias("values")]


def with_table_columns(items: DataFrame) -> DataFrame:
    """Header-keyed cells of table rows: ``keys`` in order and a ``values`` map, null for other elements."""
    return items.select("*", _entries()).select("*", *_keys_and_values()).drop("_entries")


# ------------------------------------------------------------------ fields

SPECS = f"array<struct<name: string, plan: {select.PLAN}, attr: string, pattern: string, part: int>>"


def field_spec(name: str, selector: str | None, attr: str | None, pattern: str | None) -> dict:
    """A field as a row of ``SPECS``; ``part`` is the group of the pattern that is read."""
    return {"name": name, "plan": select.plan(selector) if selector else None, "attr": attr or None, "pattern": pattern or None, "part": int(_has_group(pattern or ""))}


def _has_group(pattern: str) -> bool:
    bare = re.sub(r"\\.|\[\^?\]?[^\]]*\]", "", pattern)
    return re.search(r"\((?!\?)|\(\?<(?![=!])", bare) is not None


@built
def field_values() -> Column:
    """The value of each of ``specs`` for an item, null where it has none."""

    def read(node: Column, spec: Column) -> Column:
        attr = F.try_element_at(node["attrs"], F.lower(spec["attr"]))
        linked = F.when(spec["attr"].isin("href", "src"), urls.resolve(attr, F.col("base"))).otherwise(attr)
        return F.when(spec["attr"].isNotNull(), linked).otherwise(tx.collapse(_text_in(node)))

    def cut(value: Column, spec: Column) -> Column:
        # The first group where the pattern has one, else the whole match.
        found = F.when(F.rlike(value, spec["pattern"]), F.call_function("regexp_extract", value, spec["pattern"], spec["part"]))
        return F.nullif(F.when(spec["pattern"].isNotNull(), found).otherwise(value), F.lit(""))

    def value(spec: Column, place: Column) -> Column:
        node = F.when(spec["plan"].isNull(), F.col("me")).otherwise(F.get("sub", F.get("hits", place)))
        return let(let(node, lambda n: read(n, spec)), lambda v: cut(v, spec))

    return F.transform("specs", value)


def with_field_columns(items: DataFrame, keys: list[str], fields: dict[str, dict[str, str]]) -> DataFrame:
    """One column per field; rows without any value are dropped. Fields may have any name but those of the keys."""
    taken = {k.lower() for k in (*keys, "item_idx", "target_id", "page_idx", "item_no")} & {n.lower() for n in fields}
    if taken:
        raise ValueError(f"Names of fields are those of keys: {', '.join(sorted(taken))}")
    rows = select_where(items, [*keys, "item_idx"], [field_values().alias("_values")], lambda r: F.exists(r["_values"], lambda v: v.isNotNull()))
    return rows.select(*keys, "item_idx", *[F.get("_values", F.lit(i)).alias(name) for i, name in enumerate(fields)])


def specs_of(fields: dict[str, dict[str, str]] | None) -> Column:
    """Fields as a literal column of ``SPECS``; null without any."""
    if not fields:
        return F.lit(None).cast(SPECS)
    return select.literal([field_spec(n, f.get("selector"), f.get("attr"), f.get("regex")) for n, f in fields.items()], SPECS)


def extract_items(
    pages: DataFrame,
    selector: str | Column,
    fields: dict[str, dict[str, str]] | None = None,
    keys: list[str] | None = None,
) -> DataFrame:
    """Rows of every page. ``selector`` is one for all, or a column of ``select.PLAN``.

    With ``fields`` each field is a column. Otherwise table rows give ``keys``
    and ``values`` and other elements the seven generic columns.
    """
    keys = keys or ["page_id"]
    own = [] if isinstance(selector, str) else [selector.alias("_plan")]
    parsed = dom.parse(pages.select(*dict.fromkeys([*keys, "url", "html"]), *own))
    ids = select.match_ids(F.col("nodes"), selector) if isinstance(selector, str) else select.match_ids_by(F.col("nodes"), F.col("_plan"))
    parsed = parsed.select(*dict.fromkeys([*keys, "url"]), "nodes", "content", ids.alias("ids"), specs_of(fields).alias("specs"))
    items = explode_items(parsed, keys, tables=not fields)
    return with_field_columns(items, keys, fields) if fields else dispatched(items, keys)


def dispatched(items: DataFrame, keys: list[str]) -> DataFrame:
    """Table rows one way, everything else the other, in a single pass; rows without anything are dropped."""
    staged, columns = dispatch_inputs(items, keys)
    return select_where(staged, [*keys, "item_idx"], [F.col("is_row"), F.col("keys"), F.col("values"), *columns], is_usable).drop("is_row")


def dispatch_inputs(items: DataFrame, keys: list[str], extra: list[str] | None = None) -> tuple[DataFrame, list[Column]]:
    is_row = F.col("me")["tag"] == "tr"
    rows = with_table_columns(items)
    # The generic columns of a table row, or of an item with fields, are not computed: it has no input left.
    plain = ~is_row & F.col("specs").isNull()
    rest = rows.select(
        *keys,
        "item_idx",
        *(extra or []),
        "base",
        "keys",
        "values",
        is_row.alias("is_row"),
        *[F.when(plain, F.col(c)).alias(c) for c in ("me", "sub", "own")],
    )
    return generic_columns(rest, keys, ["is_row", "keys", "values", *(extra or [])])


def is_usable(r: Column) -> Column:
    generic = (r["title"] != "") | r["link"].isNotNull() | r["image"].isNotNull()
    return F.when(r["is_row"], r["keys"].isNotNull()).otherwise(generic)


def as_record(columns: list[str]) -> Column:
    """Canonical text of a record, for comparing whole records."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})


def fingerprint(columns: list[str]) -> Column:
    return F.sha1(as_record(columns))


# ------------------------------------------------------------------ across pages


def distinct_items(rows: DataFrame, marked: str | None = None) -> DataFrame:
    """First of equal records per target, in page and item order; with their fingerprints in column ``marked``.

    Grouped by (target, fingerprint) with a combine before the shuffle: a
    record copied a billion times costs one row per task.
    """
    payload = [c for c in rows.columns if c not in ("target_id", "page_idx", "item_idx")]
    prints = rows.withColumn("_fp", fingerprint(payload))
    kept = F.struct("page_idx", "item_idx", *[F.col(f"`{c}`") for c in payload])
    best = prints.groupBy("target_id", "_fp").agg(
        F.min_by(kept, F.struct("page_idx", "item_idx")).alias("k")
    )
    return best.select("target_id", *([F.col("_fp").alias(marked)] if marked else []), "k.*")


def walked_pages(chain: DataFrame, added: DataFrame) -> DataFrame:
    """Pages a target really reads, with ``added`` rows and rows ``before``.

    ``chain`` has target_id, page_idx, max_items, and ``carried``, the rows of earlier
    rounds; ``added`` the new rows of its pages. After the first page, a page without
    new rows ends the walk; so does reaching the row limit. ``ends`` says that a page
    is the last for one of these reasons.
    """
    counted = chain.join(added, ["target_id", "page_idx"], "left").withColumn(
        "added", F.coalesce("added", F.lit(0))
    )
    earlier = W.partitionBy("target_id").orderBy("page_idx").rowsBetween(W.unboundedPreceding, -1)
    dry = (F.col("page_idx") > 0) & (F.col("added") == 0)
    before = F.col("carried") + F.coalesce(F.sum("added").over(earlier), F.lit(0))
    ended = F.coalesce(F.max(dry).over(earlier), F.lit(False))
    rows = counted.select("*", before.alias("before"), ended.alias("_ended"), dry.alias("_dry"))
    rows = rows.where(~F.col("_ended") & (F.col("before") < F.col("max_items")))
    return rows.withColumn("ends", F.col("_dry") | (F.col("before") + F.col("added") >= F.col("max_items"))).drop("_ended", "_dry", "carried")


def capped_items(items: DataFrame, walked: DataFrame) -> DataFrame:
    """The first ``max_items`` rows of each target, over the pages it reads.

    Ranks are taken within a page and shifted by the rows before it, so no
    task has to hold a whole target.
    """
    within = W.partitionBy("target_id", "page_idx").orderBy("item_idx")
    ranked = items.withColumn("_rank", F.row_number().over(within))
    shift = walked.select("target_id", "page_idx", "before", F.col("max_items").alias("_most"))
    return (
        ranked.join(shift, ["target_id", "page_idx"])
        .withColumn("item_no", F.col("before") + F.col("_rank"))
        .where(F.col("item_no") <= F.col("_most"))
        .drop("_rank", "before", "_most")
    )
