"""Images of pages: candidates, size filter, ranking, content de-duplication.

Candidates are merged, filtered and ranked inside the page row. Joining bytes
moves only their digests and sizes; the contents are read for what is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pageloom.functions import media, urls
from pageloom.functions import text as tx
from pageloom.functions.base import checked_limit, first_of, let, runs_by_key, unnest
from pageloom.operators import dom, select
from pageloom.session import settle

MIN_BYTES = 1024
_SALTS = 8
# Digests and URLs of this many images fit a broadcast table of about 200 MB.
_BROADCAST_URLS = 1_000_000


def _attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def _pixels(value: Column) -> Column:
    """A size attribute as pixels; null for none, zero and percentages."""
    number = F.regexp_extract(value, rf"^[{tx.WS}]*(\d{{1,9}})(?![\d.]*%)", 1).try_cast("int")
    return F.nullif(number, F.lit(0))


def _candidate(raw: Column, width: Column, height: Column, alt: Column) -> Column:
    return F.struct(raw.alias("raw"), width.alias("width"), height.alias("height"), alt.alias("alt"))


def _raw_candidates(tree: Column) -> Column:
    """All image references of a page, channel by channel, in document order."""
    none = F.lit(None).cast("int")
    blank = F.lit("")

    def of_img(n: Column) -> Column:
        width, height = _pixels(_attr(n, "width")), _pixels(_attr(n, "height"))
        alt = F.coalesce(_attr(n, "alt"), blank)
        sets = media.srcset_best(F.coalesce(_attr(n, "srcset"), _attr(n, "data-srcset")))
        found = [sets, _attr(n, "src"), *[_attr(n, a) for a in media.LAZY_ATTRS]]
        sized = F.struct(width.alias("w"), height.alias("h"), alt.alias("alt"), F.array(*found).alias("raws"))
        return let(sized, lambda s: F.transform(s["raws"], lambda r: _candidate(r, s["w"], s["h"], s["alt"])))

    imgs = F.flatten(F.transform(F.filter(tree, lambda n: n["tag"] == "img"), of_img))
    sources = F.transform(
        select.match_nodes(tree, "picture source[srcset]"),
        lambda n: _candidate(media.srcset_best(_attr(n, "srcset")), none, none, blank),
    )
    styled = F.filter(tree, lambda n: F.coalesce(_attr(n, "style").contains("url("), F.lit(False)))
    shape = rf"(?i)background(?:-image)?[{tx.WS}]*:[^;]*?{media.CSS_URL}"
    backgrounds = F.filter(
        F.transform(
            styled, lambda n: _candidate(F.regexp_extract(_attr(n, "style"), shape, 2), none, none, blank)
        ),
        lambda c: ~c["raw"].startswith("data:image/svg"),
    )
    og_node = F.get(F.filter(tree, select.node_predicate("meta[property='og:image']")), F.lit(0))
    og = F.array(_candidate(_attr(og_node, "content"), none, none, F.lit("og:image")))
    return F.concat(imgs, sources, backgrounds, og)


def _base(tree: Column, url: Column) -> Column:
    """Base of the page, moved by a ``base`` element if there is one."""
    moved = _attr(F.get(F.filter(tree, select.node_predicate("base[href]")), F.lit(0)), "href")
    return let(
        urls.base_parts(url),
        lambda b: F.when(moved.isNull(), b).otherwise(urls.base_parts(urls.resolve(moved, b))),
    )


def _resolved(tree: Column, url: Column) -> Column:
    def absolute(base: Column) -> Column:
        wanted = F.filter(
            _raw_candidates(tree),
            lambda c: (tx.trim_ws(c["raw"]) != "") & ~tx.trim_ws(c["raw"]).startswith("blob:"),
        )
        return F.transform(
            wanted,
            lambda c, i: F.struct(
                urls.resolve(c["raw"], base).alias("key"), i.alias("pos"), c["width"], c["height"], c["alt"]
            ),
        )

    return F.filter(let(_base(tree, url), absolute), lambda c: c["key"].isNotNull())


def _merged(candidates: Column) -> Column:
    """One struct per URL: largest sizes, first description, first position."""

    def largest(run: Column, side: str) -> Column:
        return F.array_max(F.transform(run, lambda c: c[side]))

    merged = F.transform(
        runs_by_key(candidates),
        lambda run: F.struct(
            F.get(run, F.lit(0))["pos"].alias("pos"),
            F.get(run, F.lit(0))["key"].alias("url"),
            largest(run, "width").alias("width"),
            largest(run, "height").alias("height"),
            F.coalesce(F.get(F.filter(run, lambda c: c["alt"] != ""), F.lit(0))["alt"], F.lit("")).alias("alt"),
        ),
    )
    return F.array_sort(merged)


def _too_small(image: Column, min_width: int, min_height: int) -> Column:
    """A known size below the minimum; unknown sizes pass."""
    return F.coalesce(image["width"] < min_width, F.lit(False)) | F.coalesce(
        image["height"] < min_height, F.lit(False)
    )


def raw_images(pages: DataFrame) -> DataFrame:
    """Every image reference, before merging: ``page_id, pos, url, width, height, alt``."""
    found = F.transform(
        _resolved(F.col("nodes"), F.col("url")),
        lambda c: F.struct(c["pos"], c["key"].alias("url"), c["width"], c["height"], c["alt"]),
    )
    return unnest(dom.parse(pages.select("page_id", "url", "html")), ["page_id"], found)


def page_images(pages: DataFrame) -> DataFrame:
    """One row per image URL of a page, first seen first."""
    parsed = dom.parse(pages.select("page_id", "url", "html"))
    return unnest(parsed, ["page_id"], _merged(_resolved(F.col("nodes"), F.col("url"))))


def image_candidates(
    pages: DataFrame, min_width: int = 200, min_height: int = 200, max_images: int | None = None
) -> DataFrame:
    """Images large enough, biggest area first: ``page_id, rank, url, ...``.

    All of them: only the bytes tell which are good, so a cap belongs to
    :func:`judged_images`. ``max_images`` is for a list of the largest.
    """
    parsed = dom.parse(pages.select("page_id", "url", "html"))
    kept = F.filter(
        _merged(_resolved(F.col("nodes"), F.col("url"))),
        lambda c: ~_too_small(c, min_width, min_height),
    )

    def area(c: Column) -> Column:
        return F.coalesce(c["width"], F.lit(0)).cast("long") * F.coalesce(c["height"], F.lit(0))

    ordered = F.array_sort(F.transform(kept, lambda c: F.struct((-area(c)).alias("order"), c["pos"], c.alias("c"))))
    ordered = first_of(ordered, max_images)
    ranked = F.transform(
        ordered,
        lambda o, i: F.struct(
            (i + 1).alias("rank"), o["c"]["url"].alias("url"), o["c"]["width"].alias("width"),
            o["c"]["height"].alias("height"), o["c"]["alt"].alias("alt"),
        ),
    )
    return unnest(parsed, ["page_id"], ranked)


def size_skips(pages: DataFrame, min_width: int = 200, min_height: int = 200) -> DataFrame:
    """Images left out for their size, with the reason."""
    images = page_images(pages)
    small = _too_small(F.struct("width", "height"), min_width, min_height)
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("width", "height")]
    return images.where(small).select(
        "page_id",
        "url",
        F.concat(F.lit(f"below {min_width}x{min_height} ("), shown[0], F.lit("x"), shown[1], F.lit(")")).alias("reason"),
    )


# ------------------------------------------------------------------ bytes


def _digests(image_bytes: DataFrame) -> DataFrame:
    """One small row per URL; contents stay where they are."""
    seen = F.struct(
        "status",
        F.coalesce("content_type", F.lit("")).alias("content_type"),
        F.octet_length("content").cast("long").alias("bytes"),
        F.sha1("content").alias("sha1"),
    )
    return image_bytes.select("url", seen.alias("seen")).groupBy("url").agg(F.min("seen").alias("seen"))


def _inline_digest(url: Column) -> Column:
    """The same for a ``data:`` URL; null for other URLs, unusable ones get no sha1."""
    return F.when(
        url.startswith("data:"),
        let(
            media.data_uri(url),
            lambda d: F.struct(
                F.when(d["ok"], F.lit(200)).alias("status"),
                d["content_type"].alias("content_type"),
                F.octet_length(d["content"]).cast("long").alias("bytes"),
                F.sha1(d["content"]).alias("sha1"),
            ),
        ),
    )


def _reject_reason(seen: Column, inline: Column) -> Column:
    kind = seen["content_type"]
    return (
        F.when(inline & seen["status"].isNull(), F.lit("unparsable data URI"))
        .when(inline & seen["sha1"].isNull(), F.lit("URI malformed"))
        .when(seen.isNull(), F.lit("not captured"))
        .when(~seen["status"].between(200, 299), F.concat(F.lit("HTTP "), seen["status"].cast("string")))
        .when(
            ~inline & ~kind.startswith("image/"),
            F.concat(F.lit("not an image ("), F.when(kind == "", "unknown").otherwise(kind), F.lit(")")),
        )
        .when(
            seen["bytes"] < MIN_BYTES,
            F.concat(F.lit("too small ("), seen["bytes"].cast("string"), F.lit(" bytes)")),
        )
    )


def judged_images(candidates: DataFrame, image_bytes: DataFrame, max_images: int | None = None) -> DataFrame:
    """Each candidate with its digest and either ``file_name`` or ``reason``.

    Per page and in rank order: the first of equal contents is kept, all of
    them or until ``max_images`` are (a browser tool would take 100 by default
    and 1,000 at most); what follows is not looked at.
    """
    limit = checked_limit(max_images, "max_images") or (1 << 31) - 1
    inline = F.col("url").startswith("data:")
    # Only bytes that some candidate asks for are hashed. A picture on very many
    # pages is one row on one side; its candidates are dealt over salts.
    asked = candidates.select("url").distinct()
    digests = _digests(image_bytes.join(asked, "url", "left_semi"))
    dealt = digests.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = candidates.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)).cast("int"))
    joined = salted.join(dealt, ["url", "_salt"], "left").drop("_salt").withColumn(
        "seen", F.coalesce(_inline_digest(F.col("url")), "seen")
    )
    marked = joined.withColumn("reason", _reject_reason(F.col("seen"), inline)).withColumn(
        "sha1", F.when(F.col("reason").isNull(), F.col("seen.sha1"))
    )
    same = W.partitionBy("page_id", "sha1").orderBy("rank")
    repeated = F.col("sha1").isNotNull() & (F.row_number().over(same) > 1)
    unique = marked.withColumn(
        "reason", F.coalesce("reason", F.when(repeated, F.lit("duplicate content")))
    )
    in_order = W.partitionBy("page_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    kept_before = F.coalesce(F.sum(F.col("reason").isNull().cast("int")).over(in_order), F.lit(0))
    counted = unique.withColumn("_kept", kept_before).where(F.col("_kept") < limit)
    kind = F.col("seen.content_type")
    return counted.select(
        "page_id",
        "rank",
        "url",
        "width",
        "height",
        F.col("seen.bytes").alias("bytes"),
        F.get(F.split(kind, ";"), F.lit(0)).alias("content_type"),
        "sha1",
        F.when(
            F.col("reason").isNull(), media.image_file_name(F.col("url"), kind, F.col("_kept") + 1)
        ).alias("file_name"),
        F.when(F.col("reason") == "unparsable data URI", F.substring("url", 1, 80))
        .otherwise(F.col("url"))
        .alias("reported_url"),
        "reason",
    )


def image_contents(kept: DataFrame, image_bytes: DataFrame) -> DataFrame:
    """``sha1, content``: each distinct content of the kept images once.

    One URL stands for a content, so a picture used on a billion pages is read
    and moved once.
    """
    inline = F.col("url").startswith("data:")
    chosen = kept.groupBy("sha1").agg(F.min("url").alias("url"))
    from_pages = chosen.where(inline).select("sha1", media.data_uri(F.col("url"))["content"].alias("content"))
    wanted = chosen.where(~inline)
    small = wanted.count() <= _BROADCAST_URLS
    joined = image_bytes.select("url", "content").join(F.broadcast(wanted) if small else wanted, "url")
    stored = joined.where(F.sha1("content") == F.col("sha1")).select("sha1", "content")
    return from_pages.unionByName(stored.dropDuplicates(["sha1"]))


def image_store(candidates: DataFrame, image_bytes: DataFrame, max_images: int | None = None) -> DataFrame:
    """The kept images of each page with their contents, ready to be written.

    Contents repeat for every page that shows them. To store them once, write
    the judged rows and :func:`image_contents` instead.
    """
    kept = settle(judged_images(candidates, image_bytes, max_images).where("reason is null"))
    return kept.drop("reason", "reported_url").join(image_contents(kept, image_bytes), "sha1")


def image_skips(candidates: DataFrame, image_bytes: DataFrame, max_images: int | None = None) -> DataFrame:
    judged = judged_images(candidates, image_bytes, max_images).where("reason is not null")
    return judged.select("page_id", F.col("reported_url").alias("url"), "reason")
