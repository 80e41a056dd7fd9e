"""Lists that span pages: follow them, extract, de-duplicate, cap.

Options are one for all targets, or columns of the targets: selectors and fields are data
that native expressions interpret, so a job can hold as many different ones as targets.

Chains by the known next controls are followed over a table of all such links, with steps
that double until no chain goes on. Where a target names its own control, its chain is
walked from the target, and only pages on such chains are parsed for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.functions.base import built, checked_limit, let, select_where
from pageloom.operators import dom, lists, select
from pageloom.session import settle
from pageloom.sources.captured import first_captures

# Controls that lead to the next page, in the order they are tried.
NEXT_SELECTORS = (
    "a[rel='next']",
    ".pagination a.next",
    ".pagination .next a",
    "a.next",
    "[aria-label='Next']",
    "[aria-label='Next page']",
    "li.next > a",
)
# Pages of this many rows of a round fit a broadcast table of about 50 MB.
_BROADCAST = 500_000


_KEYS = ["target_id", "page_idx"]


def _joined(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ next pages


def _plans(selectors: tuple[str, ...]) -> Column:
    return select.literal([select.plan(s) for s in selectors], f"array<{select.PLAN}>")


@built
def _next_url(selectors: tuple[str, ...], by_row: bool = False) -> Column:
    """Where the next control of a page leads; with ``by_row`` its plans are in ``next_plans`` where that is not null."""
    tree = F.col("nodes")

    def href(node: Column) -> Column:
        attrs = node["attrs"]
        off = (
            F.map_contains_key(attrs, "disabled")
            | F.coalesce(F.try_element_at(attrs, F.lit("aria-disabled")) == "true", F.lit(False))
            | F.array_contains(node["classes"], "disabled")
        )
        return F.when(~off, F.try_element_at(attrs, F.lit("href")))

    def first(plan: Column) -> Column:
        return let(let(F.get(select.match_ids_by(tree, plan), F.lit(0)), lambda i: dom.node_at(tree, i)), href)

    plans = F.coalesce("next_plans", _plans(selectors)) if by_row else _plans(selectors)
    usable = F.get(F.filter(F.transform(plans, first), lambda h: h.isNotNull()), F.lit(0))
    return urls.resolve(usable, urls.base_parts(F.col("url"))).alias("next_url")


def next_links(pages: DataFrame, selector: str | None = None) -> DataFrame:
    """``page_id, next_url``: where each page's next control leads.

    Every known control says "next" somewhere, so other pages are not parsed.
    """
    wanted = pages.select("page_id", "url", "html")
    if not selector:
        wanted = wanted.where(F.col("html").rlike("(?i)next"))
    found = _next_url((selector,) if selector else NEXT_SELECTORS)
    return select_where(dom.parse(wanted), ["page_id"], [found], lambda r: r["next_url"].isNotNull())


def _numbered(pattern: Column, number: Column) -> Column:
    """A ``{page}`` template with its number filled in."""
    at = F.instr(pattern, "{page}")
    return F.when(at == 0, pattern).otherwise(
        F.concat(F.substr(pattern, F.lit(1), at - 1), number.cast("string"), F.substr(pattern, at + len("{page}")))
    )


# ------------------------------------------------------------------ options

_FIELD = "array<struct<name: string, selector: string, attr: string, regex: string>>"
_SPECS = pa.list_(pa.struct([("name", pa.string()), ("plan", select.ARROW_PLAN), ("attr", pa.string()), ("pattern", pa.string()), ("part", pa.int32())]))


def _with_plans(options: DataFrame) -> DataFrame:
    """Selectors and fields as data; ``problem`` says what of a target can't be used."""
    names = [*options.columns, "plan", "next_plans", "specs", "problem"]
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in options.schema.fields]
    schema = ", ".join([*kept, f"plan {select.PLAN}", f"next_plans array<{select.PLAN}>", f"specs {lists.SPECS}", "problem string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            for item, following, fields in zip(*(batch.column(n).to_pylist() for n in ("item_selector", "next_page_selector", "fields")), strict=True):
                try:
                    made.append((
                        select.plan(item) if item else None,
                        [select.plan(following)] if following else None,
                        # Of fields with one name the last counts.
                        [lists.field_spec(n, f["selector"], f["attr"], f["regex"]) for n, f in {f["name"] or "": f for f in fields}.items()] if fields else None,
                        None,
                    ))
                except select.SelectorError as error:
                    made.append((None, None, None, str(error)))
            kinds = (select.ARROW_PLAN, pa.list_(select.ARROW_PLAN), _SPECS, pa.string())
            columns = [pa.array([row[i] for row in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return options.mapInArrow(run, schema)


def _options(targets: DataFrame, given: dict[str, Column]) -> DataFrame:
    """The options of every target: its own column where it has a value, else what was given for all."""

    def option(name: str, kind: str) -> Column:
        own = F.col(name).cast(kind) if name in targets.columns else F.lit(None).cast(kind)
        return F.coalesce(own, given.get(name, F.lit(None)).cast(kind)).alias(name)

    kinds = {"page_url_pattern": "string", "start_page": "int", "max_pages": "int", "max_items": "long", "item_selector": "string", "next_page_selector": "string", "fields": _FIELD}
    rows = targets.select("target_id", "url", *[option(n, k) for n, k in kinds.items()])
    limits = (F.col("max_pages") < 1) | (F.col("max_items") < 1)
    told = F.coalesce("problem", F.when(limits, F.lit("max_pages and max_items must be at least 1")))
    return _with_plans(rows).withColumn("problem", told)


# ------------------------------------------------------------------ chains


def _captures(pages: DataFrame, frontier: DataFrame, few: bool) -> DataFrame:
    """``fetch_key, page_id`` of the frontier's documents, the first page of each. Reads URLs alone."""
    keys = frontier.select("fetch_key").where("fetch_key IS NOT NULL").distinct()
    urls_ = pages.select(urls.fetch_key(F.col("url")).alias("fetch_key"), "page_id")
    return urls_.join(F.broadcast(keys) if few else keys, "fetch_key").groupBy("fetch_key").agg(F.min("page_id").alias("page_id"))


def _doubled(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """``target_id, page_idx, fetch_key`` of chains by ``edges`` (fetch_key, next_key).

    ``starts`` has target_id, fetch_key and max_pages. Steps are doubled (1, 2, 4, ...
    links at once) until no chain goes on, so fifty pages take six joins instead of fifty.
    """
    chain = starts.select("target_id", F.lit(0).alias("page_idx"), "fetch_key", "max_pages")
    jump, step = edges, 1
    while True:
        further = chain.join(jump, "fetch_key").select("target_id", (F.col("page_idx") + step).alias("page_idx"), F.col("next_key").alias("fetch_key"), "max_pages")
        further = settle(further.where(F.col("page_idx") < F.col("max_pages")))
        if further.isEmpty():
            return chain.drop("max_pages")
        chain = chain.unionByName(further)
        # Used twice in the next step: without this the plan would double with every step.
        onward = jump.select(F.col("fetch_key").alias("next_key"), F.col("next_key").alias("onward"))
        jump = settle(jump.join(onward, "next_key").select("fetch_key", F.col("onward").alias("next_key")))
        step *= 2


def _followed(starts: DataFrame, pages: DataFrame) -> DataFrame:
    """``target_id, page_idx, fetch_key`` of chains by the controls in ``next_plans``, page by page from their starts."""
    frontier = starts.select("target_id", F.lit(0).alias("page_idx"), "fetch_key", "max_pages", "next_plans")
    steps = []
    while True:
        frontier = settle(frontier.where("fetch_key IS NOT NULL"))
        count = frontier.count()
        if not count and steps:
            return _joined(steps)
        few = count <= _BROADCAST
        steps.append(frontier.select("target_id", "page_idx", "fetch_key"))
        going = frontier.where(F.col("page_idx") + 1 < F.col("max_pages"))
        captures = _captures(pages, going, few)
        asked = going.join(F.broadcast(captures) if few else captures, "fetch_key").drop("fetch_key")
        met = _parsed(pages, asked, few).select("target_id", "page_idx", "max_pages", "next_plans", _next_url(NEXT_SELECTORS, True))
        frontier = met.select("target_id", (F.col("page_idx") + 1).alias("page_idx"), urls.fetch_key(F.col("next_url")).alias("fetch_key"), "max_pages", "next_plans")


def _chains(usable: DataFrame, pages: DataFrame) -> DataFrame:
    """``target_id, page_idx, page_id, page_url`` of the pages of all lists.

    A numbered page that was not captured keeps its place with a null page_id; a chain of
    next links ends there.
    """
    captures = first_captures(pages)
    keys = usable.withColumn("fetch_key", urls.fetch_key(F.col("url")))
    own = keys.where("page_url_pattern IS NOT NULL")
    places = own.select("*", F.explode(F.sequence(F.lit(0), F.col("max_pages") - 1)).alias("page_idx"))
    filled = urls.normalize_url(_numbered(F.col("page_url_pattern"), F.col("start_page") + F.col("page_idx")))
    numbered = places.select("target_id", "page_idx", filled.alias("page_url")).withColumn("fetch_key", urls.fetch_key(F.col("page_url")))
    parts = [numbered.join(captures, "fetch_key", "left").select("target_id", "page_idx", "page_id", "page_url")]
    rest = keys.where("page_url_pattern IS NULL AND fetch_key IS NOT NULL")
    kinds = {(r[0], r[1]) for r in rest.select(F.col("next_plans").isNotNull(), F.col("max_pages") > 1).distinct().collect()}
    chains = [rest.where("max_pages = 1").select("target_id", F.lit(0).alias("page_idx"), "fetch_key")] if {(False, False), (True, False)} & kinds else []
    if (False, True) in kinds:
        links = next_links(pages).join(captures, "page_id").select("fetch_key", urls.fetch_key(F.col("next_url")).alias("next_key"))
        chains.append(_doubled(rest.where("max_pages > 1 AND next_plans IS NULL"), settle(links.where("next_key IS NOT NULL"))))
    if (True, True) in kinds:
        chains.append(_followed(rest.where("max_pages > 1 AND next_plans IS NOT NULL"), pages))
    if chains:
        parts.append(_joined(chains).join(captures, "fetch_key").select("target_id", "page_idx", "page_id", F.col("fetch_key").alias("page_url")))
    return _joined(parts)


# ------------------------------------------------------------------ rows


def _parsed(pages: DataFrame, asked: DataFrame, few: bool) -> DataFrame:
    """``asked`` with the trees of its pages. Each page is parsed once, whoever asks for it."""
    ids = asked.select("page_id").distinct()
    parsed = dom.parse(pages.select("page_id", "url", "html").join(F.broadcast(ids) if few else ids, "page_id"))
    return parsed.join(F.broadcast(asked) if few else asked, "page_id")


def _rows(pages: DataFrame, asked: DataFrame, few: bool, wide: bool, names: list[str] | None) -> DataFrame:
    """The items of the pages of ``asked``, which has target_id, page_idx, page_id, plan and specs.

    ``wide``: targets have fields of their own; ``names``: of the fields that all targets share.
    """
    ids = select.match_ids_by(F.col("nodes"), F.col("plan")).alias("ids")
    met = _parsed(pages, asked, few).select(*_KEYS, "url", "nodes", "content", "specs", ids)
    items = lists.explode_items(met, _KEYS, tables=names is None)
    if names is not None:
        return lists.with_field_columns(items, _KEYS, dict.fromkeys(names))
    if not wide:
        return lists.dispatched(items, _KEYS)
    values = items.select("*", lists.field_values().alias("_values"))
    pairs = F.arrays_zip(F.col("specs.name").alias("name"), F.col("_values").alias("value"))
    known = F.when(F.exists("_values", lambda v: v.isNotNull()), pairs)
    staged, columns = lists.dispatch_inputs(values.select(*items.columns, known.alias("fields")), _KEYS, ["fields"])
    every = [F.col("fields"), F.col("is_row"), F.col("keys"), F.col("values"), *columns]
    return select_where(staged, [*_KEYS, "item_idx"], every, lambda r: r["fields"].isNotNull() | F.coalesce(lists.is_usable(r), F.lit(False))).drop("is_row")


class ListExtraction:
    """Result of one list extraction.

    ``items`` are the rows, ``summary`` one row per target, ``errors`` the
    targets that gave nothing and why. The distinct rows are written to the
    shared folder once; the three parts all read them.
    """

    def __init__(self, options: DataFrame, selectors: DataFrame, chain: DataFrame, rows: DataFrame):
        distinct = settle(lists.distinct_items(rows))
        added = distinct.groupBy("target_id", "page_idx").agg(F.count(F.lit(1)).alias("added"))
        self._options = options
        self._selectors = selectors
        self._walked = lists.walked_pages(chain, added)
        self.items = lists.capped_items(distinct, self._walked)

    @property
    def summary(self) -> DataFrame:
        kept = F.least(F.col("added"), F.col("max_items") - F.col("before"))
        per_target = self._walked.groupBy("target_id").agg(
            F.sum(kept).alias("item_count"),
            F.count("*").alias("page_count"),
            F.transform(
                F.array_sort(F.collect_list(F.struct("page_idx", "page_url"))), lambda p: p["page_url"]
            ).alias("pages_scraped"),
        )
        return per_target.join(self._selectors, "target_id", "left").where("item_count > 0")

    @property
    def errors(self) -> DataFrame:
        good = self.summary.select("target_id")
        failed = self._options.select("target_id", "url", "problem").join(good, "target_id", "left_anti")
        return failed.join(self._selectors, "target_id", "left").select(
            "target_id",
            F.lit("list").alias("op"),
            F.when(F.col("problem").isNotNull(), F.col("problem"))
            .when(
                F.col("selector").isNull(),
                F.lit("No known selector finds a list on the first page; name one with item_selector."),
            )
            .otherwise(
                F.concat(F.lit("No row came of the elements that "), "selector", F.lit(" finds on "), "url")
            )
            .alias("message"),
        )


def extract_list(
    targets: DataFrame,
    pages: DataFrame,
    item_selector: str | None = None,
    fields: dict[str, dict[str, str]] | None = None,
    page_url_pattern: Column | str | None = None,
    start_page: int = 1,
    next_page_selector: str | None = None,
    max_pages: int = 1,
    max_items: int | None = None,
) -> ListExtraction:
    """Rows of a repeated element, over the pages of each target's list.

    Every option may also be a column of ``targets`` of the same name, where a null
    means what is given here; ``fields`` is then an array of structs of name, selector,
    attr and regex, and the items have the map ``fields`` besides the generic columns.
    ``max_pages`` and ``max_items`` (of a target) are used as given; a browser
    tool would stop at 50 pages and 10,000 rows. A target with options that can't
    be used gives an error and no rows.

    Without ``item_selector`` it is detected on a target's first page and used
    on all its pages. A numbered page that was not captured adds no rows.
    """
    if checked_limit(max_pages, "max_pages") is None:
        raise ValueError("a list needs a number of pages to follow")
    for selector in [item_selector, next_page_selector, *[f.get("selector") for f in (fields or {}).values()]]:
        if selector:
            select.plan(selector)
    own_fields = "fields" in targets.columns
    names = list(fields) if fields and not own_fields else None
    if names:
        taken = {k.lower() for k in (*_KEYS, "item_idx", "item_no")} & {n.lower() for n in names}
        if taken:
            raise ValueError(f"Names of fields are those of keys: {', '.join(sorted(taken))}")
    listed = [{"name": n, "selector": f.get("selector"), "attr": f.get("attr"), "regex": f.get("regex")} for n, f in (fields or {}).items()]
    given = {
        "page_url_pattern": F.lit(page_url_pattern) if isinstance(page_url_pattern, str) else page_url_pattern,
        "start_page": F.lit(start_page),
        "max_pages": F.lit(max_pages),
        "max_items": F.lit(checked_limit(max_items, "max_items") or lists.NO_LIMIT),
        "item_selector": F.lit(item_selector),
        "next_page_selector": F.lit(next_page_selector),
        "fields": select.literal(listed, _FIELD) if listed else None,
    }
    options = settle(_options(targets, {k: v for k, v in given.items() if v is not None}))
    usable = options.where("problem IS NULL")
    chain = settle(_chains(usable, pages))
    captured = chain.where("page_id IS NOT NULL")
    selectors = usable.where("plan IS NOT NULL").select("target_id", F.col("item_selector").alias("selector"), F.lit(False).alias("auto_detected"))
    open_ = usable.where("plan IS NULL")
    if not open_.isEmpty():
        first = settle(captured.where("page_idx = 0").join(open_.select("target_id"), "target_id").select("target_id", "page_id"))
        best = _parsed(pages, first, first.count() <= _BROADCAST).select("target_id", lists.detected().alias("best"))
        found = settle(best.where("best IS NOT NULL").select("target_id", "best.selector", "best.rank"))
        selectors = selectors.unionByName(found.select("target_id", "selector", F.lit(True).alias("auto_detected")))
        known = found.select("target_id", F.get(lists.known_plans(), F.col("rank"))["plan"].alias("_plan"))
        usable = usable.join(known, "target_id", "left").withColumn("plan", F.coalesce("plan", "_plan")).drop("_plan")
    asked = settle(captured.join(usable.where("plan IS NOT NULL").select("target_id", "plan", "specs"), "target_id").drop("page_url"))
    rows = _rows(pages, asked, asked.count() <= _BROADCAST, own_fields, names)
    if own_fields:
        rows = rows.withColumn("fields", F.map_from_entries("fields"))
    limits = options.select("target_id", "max_items", F.lit(0).cast("long").alias("carried"))
    return ListExtraction(options, selectors, chain.drop("page_id").join(limits, "target_id"), rows)
