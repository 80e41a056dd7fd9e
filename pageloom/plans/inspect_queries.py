"""Selector discovery on shop pages made from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import inspect
from pageloom.plans import synth
from pageloom.plans.list_queries import _PARTS, money


def _card():
    """A card under class names no fixed selector knows."""
    key = F.col("p_partkey")
    return synth.cat(
        '<div class="tile-2024 c', key, '"><a href="/item/', key, '"><img src="/img/', key, '.png"><span class="label">',
        F.col("p_name"), '</span> <span class="cost">', synth.shown_price(synth.cents(F.col("p_retailprice"))),
        '</span></a><script>var x = "$1";</script><script type="application/ld+json">{"@type": "Product", "name": "',
        key, '"}</script></div>',
    )


def _shop(spark: SparkSession, sf: str) -> DataFrame:
    return synth.shop_pages(spark, sf, _card())


def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return inspect.class_counts(_shop(spark, sf))


def selector_signals(spark: SparkSession, sf: str) -> DataFrame:
    found = inspect.selector_signals(_shop(spark, sf))
    return found.select(
        "page_id", "selector", "with_link", "with_image", "with_price", "avg_text_length",
        F.array_join("sample_titles", "|").alias("titles"),
    )


def selector_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    found = inspect.suggest_selectors(_shop(spark, sf))
    return found.select("page_id", "rank", "selector", "count", "score")


def selector_hint(spark: SparkSession, sf: str) -> DataFrame:
    """Shop pages get a suggestion; pages of single brands' links a weak one or none."""
    brands = synth.shop_pages(spark, sf, synth.brand_card()).withColumn("page_id", -F.col("page_id") - 1)
    plain = synth.described_pages(spark, sf).withColumn("page_id", F.col("page_id") + 1_000_000_000)
    found = inspect.inspect_pages(_shop(spark, sf).unionByName(brands).unionByName(plain))
    return found.select("page_id", "hint")


def jsonld_products(spark: SparkSession, sf: str) -> DataFrame:
    found = inspect.inspect_pages(_shop(spark, sf))
    return found.select("page_id", "title", "json_ld_products", "total_elements")


QUERIES = {
    f.__name__: f for f in (class_counts, selector_signals, selector_suggestions, selector_hint, jsonld_products)
}

_TEXTS = f"""
    SELECT page_id, item_idx, shop, no, selector, text, link, image, price FROM (
        SELECT *, unnest(['div.tile-2024', 'span.label', 'span.cost']) AS selector,
               unnest([p_name || ' ' || shown, p_name, shown]) AS text,
               unnest([1, 0, 0]) AS link, unnest([1, 0, 0]) AS image, unnest([1, 0, 1]) AS price
        FROM (SELECT *, {money('cents')} AS shown FROM {_PARTS}))"""
_STATS = f"""
    SELECT page_id, selector, count(*) AS n, avg(link) AS l, avg(image) AS i, avg(price) AS p,
           floor(avg(length(text)) + 0.5) AS len,
           array_to_string(list(text ORDER BY item_idx)[1:3], '|') AS titles
    FROM ({_TEXTS}) GROUP BY page_id, selector"""
_SCORE = f"""
    SELECT *, floor(10 * (log10(n + 1) * (0.4 * l + 0.3 * i + 0.3 * p) *
        CASE WHEN len > 800 THEN 800 / len WHEN len < 15 THEN greatest(len, 1) / 15 ELSE 1 END * 100) + 0.5) / 10 AS score
    FROM ({_STATS})"""

ORACLE = {
    "class_counts": f"SELECT page_id, selector, CAST(n AS INTEGER) AS count FROM ({_STATS})",
    "selector_signals": f"""
        SELECT page_id, selector, CAST(l * 100 AS INTEGER) AS with_link, CAST(i * 100 AS INTEGER) AS with_image,
               CAST(p * 100 AS INTEGER) AS with_price, CAST(len AS INTEGER) AS avg_text_length, titles FROM ({_STATS})""",
    "selector_suggestions": f"""
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, selector) AS INTEGER) AS rank,
               selector, CAST(n AS INTEGER) AS count, score FROM ({_SCORE}) WHERE score > 0""",
    "selector_hint": f"""
        SELECT page_id, 'Likely list: div.tile-2024, ' || n || ' times on this page.' AS hint
        FROM ({_STATS}) WHERE selector = 'div.tile-2024'
        UNION ALL
        SELECT -page_id - 1, 'Likely list: div.product-card, ' || n || ' times on this page.'
        FROM (SELECT page_id, count(*) AS n FROM {_PARTS} GROUP BY page_id)
        UNION ALL
        SELECT 1000000000 + p_partkey, 'Nothing repeats on this page; its list may have been filled in after the capture.' FROM part""",
    "jsonld_products": f"""
        SELECT page_id, 'Parts' AS title, CAST(count(*) AS INTEGER) AS json_ld_products,
               CAST(count(*) * 7 + 7 + max(CASE WHEN no < 4 THEN 1 ELSE 0 END) AS INTEGER) AS total_elements
        FROM {_PARTS} GROUP BY page_id""",
}
