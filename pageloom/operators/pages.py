"""Page summaries: title, description, headings, links, readable text.

Everything here is a projection of the page row: no shuffle, no tree, one pass
over the scan. Only scoping by selector builds trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import text as tx
from pageloom.functions import urls
from pageloom.functions.base import first_of, first_per_key, let, select_where, start_of, unnest
from pageloom.operators import dom, select

_HIDDEN = "script|style|template|iframe|noscript"


# What a capture may tell beyond the address asked for.
CAPTURE = ("final_url", "status", "captured_at")


def base_url(pages: DataFrame) -> Column:
    """The address that a page's links are relative to."""
    return F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")


def markup(html: Column) -> Column:
    """The page without what can only mislead a scan for tags."""
    return tx.drop_elements(html, _HIDDEN)


def title(clean: Column) -> Column:
    first = tx.first_element(clean, "title")
    return F.coalesce(tx.trim_ws(tx.unescape(tx.inner(first))), F.lit(""))


def description(clean: Column) -> Column:
    def content(metas: Column, attr: str, value: str) -> Column:
        hits = F.filter(metas, lambda m: tx.attribute(m, attr, decode=False) == value)
        return F.nullif(tx.attribute(F.get(hits, F.lit(0)), "content", decode=False), F.lit(""))

    return let(
        tx.start_tags(clean, "meta"),
        lambda metas: tx.trim_ws(
            tx.unescape(
                F.coalesce(
                    content(metas, "name", "description"),
                    content(metas, "property", "og:description"),
                    F.lit(""),
                )
            )
        ),
    )


def headings(clean: Column, limit: int | None = None) -> Column:
    """Non-empty h1 to h3 in document order: ``array<struct<level, text>>``.

    All of them, or the first ``limit``; a browser tool would stop at 200.
    """
    found = F.transform(
        tx.elements(clean, "h[1-6]"),
        lambda h: F.struct(
            F.substring(h, 3, 1).cast("int").alias("level"),
            tx.collapse(tx.fragment_text(tx.inner(h))).alias("text"),
        ),
    )
    return first_of(F.filter(found, lambda h: (h["level"] <= 3) & (h["text"] != "")), limit)


def raw_links(clean: Column) -> Column:
    """Every link with a target: ``array<struct<pos, href, label>>``."""
    found = F.transform(
        tx.elements(clean, "a"),
        lambda a, i: F.struct(
            i.alias("pos"),
            tx.attribute(a, "href").alias("href"),
            tx.fragment_text(tx.inner(a)).alias("label"),
        ),
    )
    return F.filter(found, lambda a: a["href"].isNotNull())


def links(clean: Column, url: Column, limit: int | None = None, label_length: int | None = None) -> Column:
    """Distinct absolute links, first seen first: ``array<struct<pos, text, url>>``.

    All of them with their whole text, or the first ``limit`` with the first
    ``label_length`` characters; a browser tool would take 1,000 and 200.
    """

    def distinct(base: Column) -> Column:
        resolved = F.transform(
            raw_links(clean),
            lambda a: F.struct(
                urls.resolve(a["href"], base).alias("key"), a["pos"], a["label"]
            ),
        )
        firsts = first_per_key(F.filter(resolved, lambda a: a["key"].isNotNull()))
        ordered = F.array_sort(
            F.transform(firsts, lambda a: F.struct(a["pos"], a["label"], a["key"].alias("url")))
        )
        return F.transform(
            first_of(ordered, limit),
            lambda a, i: F.struct(
                i.alias("pos"),
                start_of(tx.collapse(a["label"]), label_length).alias("text"),
                a["url"].alias("url"),
            ),
        )

    return let(urls.base_parts(url), distinct)


def page_titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", title(markup(F.col("html"))).alias("title"))


def page_descriptions(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", description(markup(F.col("html"))).alias("description"))


def page_headings(pages: DataFrame, max_headings: int | None = None) -> DataFrame:
    return unnest(pages, ["page_id"], headings(markup(F.col("html")), max_headings), "pos")


def page_links(pages: DataFrame, max_links: int | None = None, label_length: int | None = None) -> DataFrame:
    return unnest(pages, ["page_id"], links(markup(F.col("html")), base_url(pages), max_links, label_length))


def page_texts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", tx.readable_text(F.col("html")).alias("text"))


def _scoped_html(selector: str) -> Column:
    parts = F.transform(
        select.match_nodes(F.col("nodes"), selector),
        lambda n: F.substr(F.col("html"), n["src_from"] + 1, n["src_to"] - n["src_from"]),
    )
    return let(parts, lambda p: F.when(F.size(p) > 0, F.array_join(p, "\n")))


def scope(pages: DataFrame, selector: str) -> DataFrame:
    """Narrow ``html`` to the matching elements, joined by newlines.

    Pages without a match get a null; :func:`scope_errors` reports them.
    """
    parsed = dom.parse(pages, keep_html=True)
    return parsed.select(
        *[c for c in pages.columns if c != "html"], _scoped_html(selector).alias("html")
    )


def _in_scope(pages: DataFrame, selector: str) -> DataFrame:
    """:func:`scope` without the pages that have no match."""
    kept = [c for c in pages.columns if c != "html"]
    parsed = dom.parse(pages, keep_html=True)
    return select_where(parsed, kept, [_scoped_html(selector).alias("html")], lambda r: r["html"].isNotNull())


def scope_errors(pages: DataFrame, selector: str) -> DataFrame:
    missing = scope(pages.select("page_id", "url", "html"), selector).where("html is null")
    return missing.select(
        F.col("page_id").alias("target_id"),
        F.lit("text").alias("op"),
        F.concat(
            F.lit(f"No element fits {selector} on "), F.col("url")
        ).alias("message"),
    )


def page_summary(
    pages: DataFrame,
    selector: str | None = None,
    include_html: bool = False,
    include_links: bool = True,
    max_headings: int | None = None,
    max_links: int | None = None,
    label_length: int | None = None,
) -> DataFrame:
    """One row per page. ``selector`` narrows text and html, not the rest.

    Links of a redirected page are resolved against its ``final_url``, where
    there is such a column; it, ``status`` and ``captured_at`` are handed on.
    """
    if selector is None:
        scoped = pages.withColumn("_scoped", F.col("html"))
    else:
        full = pages.withColumn("_full", F.col("html"))
        scoped = (
            _in_scope(full, selector)
            .withColumnRenamed("html", "_scoped")
            .withColumnRenamed("_full", "html")
        )
    captured = [c for c in CAPTURE if c in scoped.columns]
    staged = scoped.select(
        "page_id",
        "url",
        *captured,
        base_url(scoped).alias("_base"),
        "_scoped",
        markup(F.col("html")).alias("_clean"),
        tx.readable_text(F.col("_scoped")).alias("text"),
    )
    clean = F.col("_clean")
    columns = [
        F.col("page_id"),
        F.col("url"),
        *[F.col(c) for c in captured],
        title(clean).alias("title"),
        description(clean).alias("description"),
        F.col("text"),
        F.length("text").alias("text_length"),
        F.length("_scoped").alias("html_length"),
        headings(clean, max_headings).alias("headings"),
    ]
    if include_links:
        columns.append(links(clean, F.col("_base"), max_links, label_length).alias("links"))
    if include_html:
        columns.append(F.col("_scoped").alias("html"))
    return staged.select(*columns)
