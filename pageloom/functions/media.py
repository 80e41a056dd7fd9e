"""Image columns: ``srcset`` lists, inline images, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.base import let
from pageloom.functions.text import WS, trim_ws
from pageloom.functions.urls import last_segment, percent_decode

# File extension by media type, and attributes that hold images,
# best first.
EXTENSIONS = {
    "image/jpeg": ".jpg",
    "image/jpg": ".jpg",
    "image/png": ".png",
    "image/gif": ".gif",
    "image/webp": ".webp",
    "image/avif": ".avif",
    "image/svg+xml": ".svg",
    "image/bmp": ".bmp",
    "image/x-icon": ".ico",
    "image/tiff": ".tiff",
}
IMAGE_ATTRS = (
    "srcset",
    "data-srcset",
    "data-zoom-image",
    "data-large-image",
    "src",
    "data-src",
    "data-original",
    "data-lazy-src",
)
LAZY_ATTRS = ("data-src", "data-original", "data-lazy-src", "data-zoom-image", "data-large-image")
CSS_URL = r"""url\((['"]?)(.*?)\1\)"""


def srcset_best(c: Column) -> Column:
    """URL of the largest entry of a ``srcset``; the first of equals."""

    def entry(text: Column, i: Column) -> Column:
        parts = F.split(text, rf"[{WS}]+")
        size = F.get(parts, F.lit(1))
        number = F.regexp_extract(size, r"^[+-]?\d*\.?\d+", 0).try_cast("double")
        whole = F.regexp_extract(size, r"^[+-]?\d+", 0).try_cast("double")
        width = F.when(size.endswith("w"), whole).when(size.endswith("x"), number * 1000)
        return F.struct(
            (-F.coalesce(width, F.lit(0.0))).alias("rank"), i.alias("pos"), F.get(parts, F.lit(0)).alias("url")
        )

    entries = F.filter(F.transform(F.split(c, ","), trim_ws), lambda e: e != "")
    return F.get(F.array_sort(F.transform(entries, entry)), F.lit(0))["url"]


def data_uri(url: Column) -> Column:
    """``struct<ok, content_type, content>`` of a ``data:`` URL."""
    shape = r"(?s)^data:([^;,]+)(;base64)?,(.*)\z"

    def decode(body: Column) -> Column:
        plain = F.encode(body, "UTF-8")
        # Lenient like browsers: URL-safe letters, missing padding, white space.
        b64 = F.regexp_replace(F.translate(body, "-_", "+/"), "[^A-Za-z0-9+/]", "")
        usable = F.when(F.length(b64) % 4 == 1, F.substr(b64, F.lit(1), F.length(b64) - 1)).otherwise(b64)
        padded = F.rpad(usable, F.ceil(F.length(usable) / 4).cast("int") * 4, "=")
        return F.when(F.regexp_extract(url, shape, 2) != "", F.unbase64(padded)).otherwise(plain)

    return F.struct(
        url.rlike(shape).alias("ok"),
        F.regexp_extract(url, shape, 1).alias("content_type"),
        let(percent_decode(F.regexp_extract(url, shape, 3)), decode).alias("content"),
    )


def image_file_name(url: Column, content_type: Column, index: Column) -> Column:
    """``NNN-name.ext``: safe, and ordered by ``index``."""
    types = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    kind = F.lower(trim_ws(F.get(F.split(content_type, ";"), F.lit(0))))
    decoded = F.regexp_replace(percent_decode(last_segment(url)), r"(?i)\.[a-z0-9]+\z", "")
    safe = F.regexp_replace(decoded, "[^a-zA-Z0-9._-]+", "-")
    base = F.substring(F.regexp_replace(safe, r"^-+|-+\z", ""), 1, 60)
    number = index.cast("string")
    return F.concat(
        F.when(index < 1000, F.lpad(number, 3, "0")).otherwise(number),
        F.lit("-"),
        F.coalesce(F.nullif(base, F.lit("")), F.lit("image")),
        F.coalesce(F.try_element_at(types, kind), F.lit(".jpg")),
    )
