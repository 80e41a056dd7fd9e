"""Walking from page to page inside the captured table: the contact pages of a site, in queue order.

The walk only moves URLs and ids; the markup is fetched afterwards for the pages
that were visited. The pages of lists are walked in ``paginate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.functions.base import checked_limit
from pageloom.session import settle
from pageloom.sources.captured import first_captures

NO_LIMIT = (1 << 31) - 1


def walk_contacts(targets: DataFrame, pages: DataFrame, max_pages: int | None) -> DataFrame:
    """``target_id, visit, page_id, page_url``: the pages each target visits.

    Breadth-first in document order, same origin only, at most ``max_pages``
    pages (a browser tool would stop at 10), or all that are reached. A queued URL that was not captured frees its place once it is
    reached. All targets advance together, one join per round; the state of a
    start URL is one row with arrays of the URLs of its own site. Targets that
    start at the same URL share one walk.
    """
    limit = checked_limit(max_pages, "max_pages") or NO_LIMIT
    starts = targets.select("target_id", urls.normalize_url(F.col("url")).alias("start"))
    starts = starts.where(F.col("start").isNotNull())
    unique = starts.select("start").distinct()
    if limit == 1:
        walked = unique.withColumn("fetch_key", _without_fragment("start")).join(first_captures(pages), "fetch_key")
        visits = walked.select("start", F.lit(0).alias("visit"), "page_id", F.col("start").alias("page_url"))
        return starts.join(visits, "start").select("target_id", "visit", "page_id", "page_url")

    known = _walkable(unique, pages)
    no_visits = F.array().cast("array<struct<page_id:bigint,page_url:string>>")
    state = unique.select(
        "start",
        F.array("start").alias("queue"),
        F.array("start").alias("seen"),
        no_visits.alias("visited"),
    )
    finished: list[DataFrame] = []
    while True:
        state = settle(_advance(state, known, limit))
        done = (F.size("queue") == 0) | (F.size("visited") >= limit)
        finished.append(state.where(done))
        state = state.where(~done)
        if state.isEmpty():
            break
    walks = finished[0]
    for part in finished[1:]:
        walks = walks.unionByName(part)
    visits = walks.select("start", F.posexplode("visited").alias("visit", "v")).select(
        "start", "visit", "v.page_id", "v.page_url"
    )
    return starts.join(visits, "start").select("target_id", "visit", "page_id", "page_url")


def _without_fragment(url: Column | str) -> Column:
    """Fetch key of a URL that is canonical already."""
    return F.regexp_replace(url, r"#.*\z", "")


def _walkable(starts: DataFrame, pages: DataFrame) -> DataFrame:
    """``fetch_key, page_id, candidates`` of every page a walk may visit.

    Walks stay on their origin, so pages of other origins are left out before
    their markup is looked at. The markup is read once. What a walk may visit is a start or the target of
    some contact link: a small part of a crawl, so the rounds move little.
    """
    from pageloom.operators.leads import contact_edges

    origins = starts.select(urls.url_origin(F.col("start")).alias("_origin")).distinct()
    # Counted: an origin is a short string, and beyond the bound pages are shuffled by it.
    near = F.broadcast(origins) if origins.count() <= _BROADCAST_ORIGINS else origins
    own = pages.join(near, urls.url_origin(F.col("url")) == F.col("_origin"), "left_semi")
    edges = settle(contact_edges(own))
    linked = edges.select(F.explode("candidates").alias("url"))
    wanted = linked.unionByName(starts.select(F.col("start").alias("url")))
    keys = wanted.select(_without_fragment("url").alias("fetch_key")).distinct()
    reachable = edges.join(keys, "fetch_key", "left_semi")
    first = reachable.groupBy("fetch_key").agg(
        F.min_by(F.struct("page_id", "candidates"), "page_id").alias("p")
    )
    return settle(first.select("fetch_key", "p.*"))


def _advance(state: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """Take the head of every queue; visit it if captured, queue what it adds."""
    headed = state.withColumn("current", F.get("queue", F.lit(0))).withColumn(
        "fetch_key", _without_fragment("current")
    )
    joined = headed.join(known, "fetch_key", "left")
    hit = F.col("page_id").isNotNull()
    popped = F.slice("queue", F.lit(2), F.size("queue"))
    moved = joined.select(
        "start",
        popped.alias("queue"),
        "seen",
        F.when(hit, F.concat("visited", F.array(F.struct("page_id", F.col("current").alias("page_url")))))
        .otherwise(F.col("visited"))
        .alias("visited"),
        # A start that was not captured ends its walk.
        (hit | (F.size("visited") > 0)).alias("alive"),
        F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"),
    )
    room = F.lit(limit) - F.size("visited") - F.size("queue")
    fresh = F.array_except("candidates", "seen")
    added = F.when(room > 0, F.slice(fresh, F.lit(1), F.greatest(room, F.lit(0)))).otherwise(
        F.array().cast("array<string>")
    )
    return (
        moved.where("alive")
        .withColumn("added", added)
        .select(
            "start",
            F.concat("queue", "added").alias("queue"),
            F.concat("seen", "added").alias("seen"),
            "visited",
        )
    )


def walk_errors(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets whose first page is no URL or was not captured."""
    named = targets.select(
        "target_id",
        "url",
        urls.fetch_key(F.col("url")).alias("fetch_key"),
        urls.normalize_error(F.col("url")).alias("problem"),
    )
    missing = named.join(first_captures(pages), "fetch_key", "left_anti")
    return missing.select(
        "target_id",
        F.lit("leads").alias("op"),
        F.coalesce("problem", F.concat(F.lit("Page was not captured: "), F.col("url"))).alias("message"),
    )


# Origins of this many sites fit a broadcast table of about 50 MB.
_BROADCAST_ORIGINS = 500_000
# Ids of this many pages fit a broadcast table of about 50 MB.
_BROADCAST_PAGES = 2_000_000
# From this share on it is cheaper to read all pages than to move their markup.
_MOST = 0.1


def only_pages(pages: DataFrame, wanted: DataFrame, filtered_later: bool = False) -> DataFrame:
    """``pages`` joined to ``wanted`` (by ``page_id``), markup left in place.

    The wanted side is counted: up to the bound it is broadcast and no markup
    moves. Beyond it the pages are shuffled once by id, unless the caller joins
    its own small rows later anyway and a good part of the pages is wanted.
    """
    count = wanted.count()
    if count <= _BROADCAST_PAGES:
        return pages.join(F.broadcast(wanted), "page_id")
    if filtered_later and count >= _MOST * pages.count():
        return pages
    return pages.join(wanted, "page_id")
