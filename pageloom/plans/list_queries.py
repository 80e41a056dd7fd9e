"""Queries that turn synthesised lists and tables back into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import lists, pages, paginate
from pageloom.plans import synth

FIELDS = {
    "name": {"selector": ".title"},
    "part_no": {"selector": "h3", "regex": r"(\d+)$"},
    "shown": {"selector": "div > .price"},
    "link": {"selector": "a", "attr": "href"},
    "missing": {"selector": ".nothing"},
}


def page_description(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_descriptions(synth.described_pages(spark, sf))


def list_generic(spark: SparkSession, sf: str) -> DataFrame:
    shop = synth.shop_pages(spark, sf, synth.part_card())
    return lists.extract_items(shop, ".product-card").select("page_id", "item_idx", *lists.GENERIC)


def list_fields(spark: SparkSession, sf: str) -> DataFrame:
    shop = synth.shop_pages(spark, sf, synth.part_card())
    return lists.extract_items(shop, ".product-card", FIELDS).select("page_id", *FIELDS)


def list_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = lists.extract_items(synth.customer_tables(spark, sf), "table tbody tr")
    value = F.col("values")
    return rows.where(value["Key"] != "Key").select(
        "page_id",
        F.array_join("keys", "|").alias("columns"),
        value["Key"].alias("key"),
        value["Name"].alias("name"),
        value["Name_link"].alias("link"),
        value["Segment"].alias("segment"),
        value["column_4"].alias("balance"),
    )


def autodetect_selector(spark: SparkSession, sf: str) -> DataFrame:
    shops = synth.shop_pages(spark, sf, synth.part_card())
    tables = synth.customer_tables(spark, sf).withColumn("page_id", -F.col("page_id") - 1)
    return lists.detect_selectors(shops.unionByName(tables)).select(
        "page_id", "selector", "matches", F.round("score", 6).alias("score")
    )


def _paged(spark: SparkSession, sf: str, card, **options) -> paginate.ListExtraction:
    return paginate.extract_list(
        synth.shop_targets(spark, sf), synth.captured(synth.shop_pages(spark, sf, card)), **options
    )


def paginate_next(spark: SparkSession, sf: str) -> DataFrame:
    """Next links followed to the last page, selector detected on the first."""
    found = _paged(spark, sf, synth.part_card(), max_pages=99)
    return found.items.select("target_id", "page_idx", "item_no", "title", "price_value", "currency")


def paginate_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered pages from the second on; the template runs past the last page."""
    found = _paged(
        spark, sf, synth.part_card(), item_selector=".product-card", page_url_pattern=synth.shop_pattern(),
        start_page=2, max_pages=6,
    )
    return found.items.select("target_id", "page_idx", "item_no", "title")


def list_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Brand cards repeat within and across pages; the first of each stays."""
    rows = lists.extract_items(synth.shop_pages(spark, sf, synth.brand_card()), ".product-card")
    keyed = rows.select(
        F.floor(F.col("page_id") / synth.PAGES_PER_SHOP).cast("long").alias("target_id"),
        (F.col("page_id") % synth.PAGES_PER_SHOP).cast("int").alias("page_idx"),
        "item_idx",
        "title",
        "link",
    )
    return lists.distinct_items(keyed)


def paginate_stop(spark: SparkSession, sf: str) -> DataFrame:
    """Walks end at the first later page that adds no brand."""
    found = _paged(spark, sf, synth.brand_card(), item_selector=".product-card", max_pages=5)
    return found.items.select("target_id", "page_idx", "item_no", "title")


def list_cap(spark: SparkSession, sf: str) -> DataFrame:
    found = _paged(
        spark, sf, synth.part_card(), item_selector=".product-card", page_url_pattern=synth.shop_pattern(),
        max_pages=5, max_items=50,
    )
    return found.items.select("target_id", "page_idx", "item_no", "title")


def list_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = _paged(spark, sf, synth.part_card(), max_pages=99)
    return found.summary.select(
        "target_id",
        "selector",
        "auto_detected",
        "item_count",
        "page_count",
        F.array_join("pages_scraped", " ").alias("pages_scraped"),
    )


def list_errors(spark: SparkSession, sf: str) -> DataFrame:
    found = _paged(spark, sf, synth.part_card(), item_selector=".no-such-item", max_pages=99)
    return found.errors


def list_per_target(spark: SparkSession, sf: str) -> DataFrame:
    """One job, four kinds of targets: each with selectors, fields, pages and limits of its own."""
    kind = F.col("target_id") % 4
    named = F.array(
        F.struct(F.lit("part").alias("name"), F.lit("h3").alias("selector"), F.lit(None).cast("string").alias("attr"), F.lit(r"(\d+)$").alias("regex")),
        F.struct(F.lit("to").alias("name"), F.lit("div > a").alias("selector"), F.lit("href").alias("attr"), F.lit(None).cast("string").alias("regex")),
    )
    targets = synth.shop_targets(spark, sf).select(
        "*",
        F.when(kind == 0, ".product-card").when(kind == 1, "div.grid > div:has(img)").when(kind == 3, "[class^='product']").alias("item_selector"),
        F.when(kind == 1, synth.shop_pattern()).alias("page_url_pattern"),
        F.when(kind == 1, 2).alias("start_page"),
        F.when(kind == 1, 3).when(kind == 3, 2).otherwise(99).alias("max_pages"),
        F.when(kind == 2, 30).alias("max_items"),
        F.when(kind == 3, ".pagination > a[rel=next]").alias("next_page_selector"),
        F.when(kind == 3, named).alias("fields"),
    )
    found = paginate.extract_list(targets, synth.captured(synth.shop_pages(spark, sf, synth.part_card())))
    fields = F.col("fields")
    return found.items.select("target_id", "page_idx", "item_no", "title", fields["part"].alias("part"), fields["to"].alias("to"))


QUERIES = {
    f.__name__: f
    for f in (
        page_description,
        list_generic,
        list_fields,
        list_table,
        autodetect_selector,
        paginate_next,
        paginate_pattern,
        list_dedupe,
        paginate_stop,
        list_cap,
        list_summary,
        list_errors,
        list_per_target,
    )
}


def money(value: str) -> str:
    """SQL for :func:`synth.shown_price` of a column of cents."""
    fraction = f"lpad(CAST({value} % 100 AS VARCHAR), 2, '0')"
    return (
        f"CASE WHEN {value} % 2 = 0 THEN '$' || format('{{:,}}', {value} // 100) || '.' || {fraction} "
        f"ELSE replace(format('{{:,}}', {value} // 100), ',', '.') || ',' || {fraction} || ' TL' END"
    )


_PARTS = f"""(SELECT *, p_partkey // 100 AS shop, CAST(p_partkey // 20 % 5 AS INTEGER) AS no,
              p_partkey // 20 AS page_id, CAST(p_partkey % 20 AS INTEGER) AS item_idx,
              p_name || ' ' || p_partkey AS title, CAST(round(p_retailprice * 100) AS BIGINT) AS cents
              FROM part)"""
_BRANDS = f"""(SELECT shop, p_brand, min(no * 100 + item_idx) AS first FROM {_PARTS} GROUP BY shop, p_brand)"""

ORACLE = {
    "page_description": """
        SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN p_name || ' & more' WHEN 3 THEN '' ELSE p_name END AS description
        FROM part""",
    "list_generic": f"""
        SELECT page_id, item_idx, title, shown AS price, cents / 100 AS price_value,
               CASE WHEN cents % 2 = 0 THEN 'USD' ELSE 'TRY' END AS currency,
               'https://shop.test/item/' || p_partkey AS link, 'https://shop.test/img/' || p_partkey || '-l.png' AS image,
               title || shown || 'Details' AS text
        FROM (SELECT *, {money('cents')} AS shown FROM {_PARTS})""",
    "list_fields": f"""
        SELECT page_id, title AS name, CAST(p_partkey AS VARCHAR) AS part_no, {money('cents')} AS shown,
               'https://shop.test/item/' || p_partkey AS link, CAST(NULL AS VARCHAR) AS missing
        FROM {_PARTS}""",
    "list_table": f"""
        SELECT c_custkey // 50 AS page_id, 'Key|Name|Name_link|Segment|column_4' AS columns, CAST(c_custkey AS VARCHAR) AS key,
               c_name AS name, 'https://shop.test/c/' || c_custkey AS link, c_mktsegment AS segment, {money('cents')} AS balance
        FROM (SELECT *, abs(CAST(round(c_acctbal * 100) AS BIGINT)) AS cents FROM customer)""",
    "autodetect_selector": f"""
        SELECT page_id, '.product-card' AS selector, CAST(count(*) AS INTEGER) AS matches, round(log10(count(*) + 1) * 100, 6) AS score
        FROM {_PARTS} GROUP BY page_id
        UNION ALL
        SELECT -page_id - 1, 'table tbody tr', CAST(n AS INTEGER), round(log10(n + 1) * 100, 6)
        FROM (SELECT c_custkey // 50 AS page_id, count(*) + c_custkey // 50 % 2 AS n FROM customer GROUP BY 1)""",
    "paginate_next": f"""
        SELECT shop AS target_id, no AS page_idx, CAST(no * 20 + item_idx + 1 AS BIGINT) AS item_no, title, cents / 100 AS price_value,
               CASE WHEN cents % 2 = 0 THEN 'USD' ELSE 'TRY' END AS currency
        FROM {_PARTS}""",
    "paginate_pattern": f"""
        SELECT shop AS target_id, no - 1 AS page_idx, CAST((no - 1) * 20 + item_idx + 1 AS BIGINT) AS item_no, title FROM {_PARTS} WHERE no > 0""",
    "list_dedupe": f"""
        SELECT shop AS target_id, CAST(first // 100 AS INTEGER) AS page_idx, CAST(first % 100 AS INTEGER) AS item_idx,
               p_brand AS title, 'https://shop.test/brand/' || replace(p_brand, '#', '-') AS link
        FROM {_BRANDS}""",
    "paginate_stop": f"""
        WITH firsts AS (SELECT shop, p_brand, first, first // 100 AS no FROM {_BRANDS}),
             stops AS (SELECT s.shop, min(p.no) AS stop
                       FROM (SELECT DISTINCT shop FROM firsts) s, (SELECT unnest([1, 2, 3, 4]) AS no) p
                       WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.shop = s.shop AND f.no = p.no) GROUP BY s.shop)
        SELECT f.shop AS target_id, CAST(no AS INTEGER) AS page_idx, row_number() OVER (PARTITION BY f.shop ORDER BY first) AS item_no,
               p_brand AS title
        FROM firsts f LEFT JOIN stops s ON s.shop = f.shop WHERE no < coalesce(stop, 5)""",
    "list_cap": f"""
        SELECT shop AS target_id, no AS page_idx, CAST(no * 20 + item_idx + 1 AS BIGINT) AS item_no, title FROM {_PARTS} WHERE no * 20 + item_idx < 50""",
    "list_summary": f"""
        SELECT shop AS target_id, '.product-card' AS selector, true AS auto_detected, count(*) AS item_count,
               CAST(max(no) + 1 AS BIGINT) AS page_count,
               array_to_string(list_transform(range(1, max(no) + 2),
                   lambda i: 'https://shop.test/s' || shop || '/list?page=' || i), ' ') AS pages_scraped
        FROM {_PARTS} GROUP BY shop""",
    "list_per_target": f"""
        SELECT shop AS target_id, CASE shop % 4 WHEN 1 THEN no - 1 ELSE no END AS page_idx,
               CAST(CASE shop % 4 WHEN 1 THEN no - 1 ELSE no END * 20 + item_idx + 1 AS BIGINT) AS item_no,
               CASE WHEN shop % 4 <> 3 THEN title END AS title, CASE WHEN shop % 4 = 3 THEN CAST(p_partkey AS VARCHAR) END AS part,
               CASE WHEN shop % 4 = 3 THEN 'https://shop.test/item/' || p_partkey END AS "to"
        FROM {_PARTS}
        WHERE CASE shop % 4 WHEN 0 THEN true WHEN 1 THEN no BETWEEN 1 AND 3 WHEN 2 THEN no * 20 + item_idx < 30 ELSE no < 2 END""",
    "list_errors": """
        SELECT DISTINCT p_partkey // 100 AS target_id, 'list' AS op,
               'No row came of the elements that .no-such-item finds on https://shop.test/s' || p_partkey // 100 || '/list?page=1' AS message
        FROM part""",
}
