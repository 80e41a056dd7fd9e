"""Captured input: page tables and image bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions import urls

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


# What a crawler may also know about a capture. Links are relative to final_url.
CAPTURED = T.StructType(
    [
        *PAGES.fields,
        T.StructField("final_url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("captured_at", T.TimestampType()),
    ]
)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core on an input that arrives in fewer pieces than cores.

    One unsplittable file would keep one core busy. A large input has more
    splits than cores and is left as it is: its rows never move.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The captured pages of a crawl."""
    return spread(read_table(spark, folder, "pages"), "page_id")


def first_captures(pages: DataFrame) -> DataFrame:
    """``(fetch_key, page_id)`` with one page per document.

    A document captured many times keeps its first page. Only keys and ids are
    shuffled, and they are combined before the shuffle, so a much-captured URL
    costs no more than any other. Pages without a usable URL share a null key,
    which no join matches.
    """
    return (
        pages.select(urls.fetch_key(F.col("url")).alias("fetch_key"), "page_id")
        .groupBy("fetch_key")
        .agg(F.min("page_id").alias("page_id"))
    )


def read_image_files(spark: SparkSession, folder: str, url_prefix: str) -> DataFrame:
    """Image files from a folder, in the ``image_bytes`` layout."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([a-zA-Z0-9]+)$", 1))
    kind = (
        F.when(ext.isin("jpg", "jpeg"), "image/jpeg")
        .when(ext == "svg", "image/svg+xml")
        .when(ext == "ico", "image/x-icon")
        .when(ext.isin("png", "gif", "webp", "avif", "bmp", "tiff"), F.concat(F.lit("image/"), ext))
        .otherwise("application/octet-stream")
    )
    return files.select(
        F.concat(F.lit(url_prefix), name).alias("url"),
        F.lit(200).alias("status"),
        kind.alias("content_type"),
        "content",
    )
