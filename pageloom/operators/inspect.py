"""Which repeated element is the list? Ranked suggestions per page.

All of it happens inside the page row: class tokens are grouped by sorting an
array, and every element of a token is looked at unless a sample is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import prices
from pageloom.functions import text as tx
from pageloom.functions.base import first_of, let, runs_by_key, unnest
from pageloom.operators import dom

# Limits and weights of the scoring.
SKIPPED_TAGS = ("html", "body", "head", "script", "style", "noscript", "svg", "path", "option")
TOKEN = r"^[a-zA-Z][a-zA-Z0-9_-]{1,40}$"
MIN_COUNT = 3
TITLES = 3  # example titles that a suggestion shows
LINK_WEIGHT, IMAGE_WEIGHT, PRICE_WEIGHT = 0.4, 0.3, 0.3
LONG_TEXT, SHORT_TEXT = 800, 15
WEAK_SCORE = 10
JSON_LD_PRODUCT = rf'"@type"[{tx.WS}]*:[{tx.WS}]*"Product"'


def _js_round(c: Column) -> Column:
    return F.floor(c + 0.5)


def _tokens(tree: Column) -> Column:
    """``array<struct<key, id, place>>`` of every usable class token."""

    def of_node(n: Column) -> Column:
        usable = F.filter(F.array_distinct(n["classes"]), lambda c: c.rlike(TOKEN))
        return F.transform(
            usable,
            lambda c, i: F.struct(F.concat(n["tag"], F.lit("."), c).alias("key"), n["id"], i.alias("place")),
        )

    carriers = F.filter(tree, lambda n: (F.size(n["classes"]) > 0) & ~n["tag"].isin(*SKIPPED_TAGS))
    return F.flatten(F.transform(carriers, of_node))


def _repeated(tree: Column, low: int, high: int | None) -> Column:
    return F.filter(runs_by_key(_tokens(tree)), lambda run: (F.size(run) >= low) & (F.lit(True) if high is None else F.size(run) <= high))


def _signals(tree: Column, content: Column, hidden: Column, node: Column) -> Column:
    """What one sampled element shows."""
    background = F.coalesce(
        F.try_element_at(node["attrs"], F.lit("style")).rlike(r"(?i)background(?:-image)?\s*:[^;]*url\("), F.lit(False)
    )
    return let(
        tx.squash(dom.visible_text_of(content, node, hidden)),
        lambda t: F.struct(
            t.alias("text"),
            F.length(t).alias("length"),
            (dom.holds_link(tree, node) | dom.is_link(node)).cast("int").alias("link"),
            (dom.holds_image(tree, node) | background).cast("int").alias("image"),
            t.rlike(prices.SCORED_PRICE).cast("int").alias("price"),
        ),
    )


def _scored(run: Column, samples: Column) -> Column:
    """Suggestion for one token from its sampled elements."""
    first = F.get(run, F.lit(0))
    sampled = F.size(samples)

    def total(name: str) -> Column:
        return F.aggregate(samples, F.lit(0), lambda acc, s: acc + s[name])

    def with_ratios(r: Column) -> Column:
        length = r["length"]
        factor = (
            F.when(length > LONG_TEXT, F.lit(float(LONG_TEXT)) / length)
            .when(length < SHORT_TEXT, F.greatest(length, F.lit(1)) / F.lit(float(SHORT_TEXT)))
            .otherwise(F.lit(1.0))
        )
        mix = F.lit(LINK_WEIGHT) * r["link"] + F.lit(IMAGE_WEIGHT) * r["image"] + F.lit(PRICE_WEIGHT) * r["price"]
        score = F.log10(F.size(run) + F.lit(1)) * mix * factor * 100
        titles = F.transform(
            F.slice(F.filter(samples, lambda s: s["text"] != ""), 1, TITLES),
            lambda s: s["text"],
        )
        return F.struct(
            (-_js_round(score * 10) / 10).alias("order"),
            first["id"].alias("first_id"),
            first["place"].alias("place"),
            score.alias("exact"),
            first["key"].alias("selector"),
            F.size(run).alias("count"),
            _js_round(r["link"] * 100).cast("int").alias("with_link"),
            _js_round(r["image"] * 100).cast("int").alias("with_image"),
            _js_round(r["price"] * 100).cast("int").alias("with_price"),
            length.cast("int").alias("avg_text_length"),
            titles.alias("sample_titles"),
            (_js_round(score * 10) / 10).alias("score"),
        )

    ratios = F.struct(
        (total("link") / sampled).alias("link"),
        (total("image") / sampled).alias("image"),
        (total("price") / sampled).alias("price"),
        _js_round(total("length") / sampled).alias("length"),
    )
    return let(ratios, with_ratios)


def _all_scored(tree: Column, content: Column, sample: int | None = None, high: int | None = None) -> Column:
    def judge(hidden: Column) -> Column:
        def of_run(run: Column) -> Column:
            samples = F.transform(
                first_of(run, sample),
                lambda t: let(dom.node_at(tree, t["id"]), lambda n: _signals(tree, content, hidden, n)),
            )
            return let(samples, lambda s: _scored(run, s))

        return F.transform(_repeated(tree, MIN_COUNT, high), of_run)

    return let(dom.hidden_ranges(tree), judge)


def _ranked(scored: Column, shown: int | None = None) -> Column:
    return first_of(F.array_sort(F.filter(scored, lambda s: s["exact"] > 0)), shown)


_PUBLIC = (
    "selector", "count", "with_link", "with_image", "with_price", "avg_text_length", "sample_titles", "score",
)


def class_counts(pages: DataFrame, low: int = MIN_COUNT, high: int | None = None) -> DataFrame:
    """``page_id, selector, count`` of the class tokens that repeat enough."""
    found = F.transform(
        _repeated(F.col("nodes"), low, high),
        lambda run: F.struct(F.get(run, F.lit(0))["key"].alias("selector"), F.size(run).alias("count")),
    )
    return unnest(dom.parse(pages.select("page_id", "html")), ["page_id"], found)


def selector_signals(pages: DataFrame, sample: int | None = None, high: int | None = None) -> DataFrame:
    """Signals of every repeated token, also of those that score nothing.

    A browser tool would look at the first 40 elements of a token and at no
    token with more than 2,000.
    """
    parsed = dom.parse(pages.select("page_id", "html"))
    rows = unnest(parsed, ["page_id"], _all_scored(F.col("nodes"), F.col("content"), sample, high))
    return rows.select("page_id", *_PUBLIC)


def _hint(best: Column) -> Column:
    name, count = best["selector"], best["count"].cast("string")
    return (
        F.when(
            best.isNull(),
            F.lit("Nothing repeats on this page; its list may have been filled in after the capture."),
        )
        .when(
            best["score"] < WEAK_SCORE,
            F.concat(F.lit("Doubtful: "), name, F.lit(" stands "), count, F.lit(" times; look at its titles first.")),
        )
        .otherwise(F.concat(F.lit("Likely list: "), name, F.lit(", "), count, F.lit(" times on this page.")))
    )


def inspect_pages(pages: DataFrame, shown: int | None = None, sample: int | None = None, high: int | None = None) -> DataFrame:
    """One row per page: suggestions, JSON-LD products, elements, hint."""
    parsed = dom.parse(pages.select("page_id", "url", "html"))
    tree, content = F.col("nodes"), F.col("content")
    title_node = F.get(F.filter(tree, lambda n: n["tag"] == "title"), F.lit(0))
    scripts = F.filter(
        tree,
        lambda n: (n["tag"] == "script")
        & F.coalesce(F.try_element_at(n["attrs"], F.lit("type")) == "application/ld+json", F.lit(False)),
    )
    products = F.aggregate(
        scripts,
        F.lit(0),
        lambda acc, n: acc
        + F.size(F.regexp_extract_all(dom.text_of(content, n), F.lit(JSON_LD_PRODUCT), F.lit(0))),
    )
    staged = parsed.select(
        "page_id",
        "url",
        F.coalesce(tx.squash(dom.text_of(content, title_node)), F.lit("")).alias("title"),
        _ranked(_all_scored(tree, content, sample, high), shown).alias("suggestions"),
        products.alias("json_ld_products"),
        F.size(tree).alias("total_elements"),
    )
    return staged.withColumn("hint", _hint(F.get("suggestions", F.lit(0))))


def suggest_selectors(pages: DataFrame, shown: int | None = None, sample: int | None = None, high: int | None = None) -> DataFrame:
    """The suggestions of each page, by ``rank``; a browser tool would show the best 12."""
    parsed = dom.parse(pages.select("page_id", "html"))
    rows = unnest(parsed, ["page_id"], _ranked(_all_scored(F.col("nodes"), F.col("content"), sample, high), shown), "pos")
    return rows.select("page_id", (F.col("pos") + 1).alias("rank"), *_PUBLIC)
