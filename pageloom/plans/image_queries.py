"""Image queries, over part galleries and documents used as image bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import images
from pageloom.plans import synth
from pageloom.sources.captured import read_table, spread


def _sized(found: DataFrame) -> DataFrame:
    """Unknown sizes as -1, so that whole numbers stay whole on both sides."""
    size = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("width", "height")]
    return found.select("page_id", "url", *size, "alt")


def image_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _sized(images.raw_images(synth.gallery_pages(spark, sf)))


def image_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _sized(images.page_images(synth.gallery_pages(spark, sf)))


def image_filter(spark: SparkSession, sf: str) -> DataFrame:
    return images.size_skips(synth.gallery_pages(spark, sf))


def image_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = images.image_candidates(synth.gallery_pages(spark, sf), max_images=5)
    return found.select("page_id", "rank", "url")


def _document_images(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents as image bytes, fifty to a page; some fail to load."""
    docs = spread(read_table(spark, sf, "documents"), "doc_id")
    url = synth.cat("https://img.test/d", F.col("doc_id"), ".png")
    candidates = docs.select(
        F.floor(F.col("doc_id") / 50).cast("long").alias("page_id"),
        (F.col("doc_id") % 50 + 1).cast("int").alias("rank"),
        url.alias("url"),
        F.lit(None).cast("int").alias("width"),
        F.lit(None).cast("int").alias("height"),
    )
    form = F.col("doc_id") % 10
    stored = docs.where(form != 3).select(
        url.alias("url"),
        F.when(form == 0, 404).otherwise(200).alias("status"),
        F.when(form == 1, "text/html").when(form == 2, None).otherwise("image/png; q=1").alias("content_type"),
        F.encode("text", "UTF-8").alias("content"),
    )
    return candidates, stored


def judged_documents(spark: SparkSession, sf: str) -> DataFrame:
    return images.judged_images(*_document_images(spark, sf))


def image_reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return images.image_skips(*_document_images(spark, sf))


def image_content_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    judged = images.judged_images(*_document_images(spark, sf))
    return judged.where("reason is null").select("page_id", "url", "sha1", "file_name")


def image_store(spark: SparkSession, sf: str) -> DataFrame:
    """Kept images with contents."""
    stored = images.image_store(*_document_images(spark, sf))
    return stored.select("page_id", "file_name", "content_type", "bytes", F.md5("content").alias("digest"))


def image_total_bytes(spark: SparkSession, sf: str) -> DataFrame:
    stored = images.judged_images(*_document_images(spark, sf)).where("reason is null")
    return stored.groupBy("page_id").agg(F.sum("bytes").alias("total_bytes"), F.count("*").alias("images"))


QUERIES = {
    f.__name__: f
    for f in (
        image_candidates,
        image_merge,
        image_filter,
        image_topk,
        image_reject_reasons,
        image_content_dedupe,
        image_store,
        image_total_bytes,
    )
}

_G = "(SELECT *, p_partkey // 20 AS page_id, p_partkey % 6 AS form, p_size * 20 AS w, p_size * 10 AS h FROM part)"
_U = "'https://shop.test/i/' || p_partkey || "
_RAW = f"""
    SELECT page_id, {_U}'.png' AS url, w AS width, h AS height, CASE form WHEN 1 THEN p_name WHEN 2 THEN 'lazy' ELSE '' END AS alt
        FROM {_G} WHERE form IN (0, 1, 2)
    UNION ALL SELECT page_id, {_U}'-b.png', w, h, p_name FROM {_G} WHERE form = 1
    UNION ALL SELECT page_id, {_U}'.webp', NULL, NULL, '' FROM {_G} WHERE form = 3
    UNION ALL SELECT page_id, {_U}'.png', NULL, NULL, '' FROM {_G} WHERE form = 4
    UNION ALL SELECT page_id, {_U}'.png', w, 10, '' FROM {_G} WHERE form = 5
    UNION ALL SELECT page_id, {_U}'.png', 10, h, 'again' FROM {_G} WHERE form = 5
    UNION ALL SELECT DISTINCT page_id, 'https://shop.test/og/' || page_id || '.png', CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), 'og:image' FROM {_G}"""
_ONE = f"SELECT page_id, url, max(width) AS width, max(height) AS height, max(alt) AS alt FROM ({_RAW}) GROUP BY page_id, url"
_KNOWN = "(width < 200 OR height < 200)"
# Rank within a page needs document order: channel by channel, then by part.
_ORDER = f"""
    SELECT page_id, url, width, height, CASE WHEN contains(url, '/og/') THEN 3 WHEN contains(url, '.webp') THEN 1
           WHEN width IS NULL THEN 2 ELSE 0 END AS channel,
           TRY_CAST(regexp_extract(url, '/i/([0-9]+)', 1) AS BIGINT) AS part, CASE WHEN contains(url, '-b.png') THEN 0 ELSE 1 END AS within
    FROM ({_ONE})"""
_SIZES = "(SELECT doc_id, doc_id // 50 AS page_id, doc_id % 50 + 1 AS rank, doc_id % 10 AS form, strlen(text) AS bytes, text, 'https://img.test/d' || doc_id || '.png' AS url FROM documents)"
_JUDGED = f"""
    SELECT *, CASE WHEN reason IS NULL AND again THEN 'duplicate content' ELSE reason END AS verdict FROM (
        SELECT *, reason IS NULL AND row_number() OVER (PARTITION BY page_id, text, reason IS NULL ORDER BY rank) > 1 AS again FROM (
            SELECT *, CASE WHEN form = 3 THEN 'not captured' WHEN form = 0 THEN 'HTTP 404' WHEN form = 1 THEN 'not an image (text/html)'
                           WHEN form = 2 THEN 'not an image (unknown)' WHEN bytes < 1024 THEN 'too small (' || bytes || ' bytes)' END AS reason
            FROM {_SIZES}))"""
_KEPT = f"""
    SELECT *, lpad(CAST(no AS VARCHAR), 3, '0') || '-d' || doc_id || '.png' AS file_name FROM (
        SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank) AS no FROM ({_JUDGED}) WHERE verdict IS NULL)"""



def _sized_sql(sql: str) -> str:
    return f"SELECT page_id, url, coalesce(width, -1) AS width, coalesce(height, -1) AS height, alt FROM ({sql})"


ORACLE = {
    "image_candidates": _sized_sql(_RAW),
    "image_merge": _sized_sql(_ONE),
    "image_filter": f"""
        SELECT page_id, url, 'below 200x200 (' || coalesce(CAST(width AS VARCHAR), 'null') || 'x' || coalesce(CAST(height AS VARCHAR), 'null') || ')' AS reason
        FROM ({_ONE}) WHERE {_KNOWN}""",
    "image_topk": f"""
        SELECT page_id, CAST(rank AS INTEGER) AS rank, url FROM (
            SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY coalesce(width * height, 0) DESC, channel, part, within) AS rank
            FROM ({_ORDER}) WHERE NOT coalesce({_KNOWN}, false)) WHERE rank <= 5""",
    "image_reject_reasons": f"SELECT page_id, url, verdict AS reason FROM ({_JUDGED}) WHERE verdict IS NOT NULL",
    "image_content_dedupe": f"SELECT page_id, url, sha1(text) AS sha1, file_name FROM ({_KEPT})",
    "image_store": f"""
        SELECT page_id, file_name, 'image/png' AS content_type, bytes, md5(text) AS digest FROM ({_KEPT})""",
    "image_total_bytes": f"SELECT page_id, CAST(sum(bytes) AS BIGINT) AS total_bytes, count(*) AS images FROM ({_KEPT}) GROUP BY page_id",
}
