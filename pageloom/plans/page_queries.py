"""Queries over the captured pages: scan, summary, links, URLs, selectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import text as tx
from pageloom.functions import urls
from pageloom.functions.base import unnest
from pageloom.operators import dom, pages, select
from pageloom.sources.captured import read_pages, read_table, spread


def page_scan(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", "url", F.length("html").alias("html_length"))


def page_title(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_titles(read_pages(spark, sf))


def page_headings(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_headings(read_pages(spark, sf))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_links(read_pages(spark, sf))


def page_text(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_texts(read_pages(spark, sf))


def page_text_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_summary(read_pages(spark, sf), selector="article", include_links=False).select(
        "page_id", "text"
    )


def page_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_summary(read_pages(spark, sf), include_links=False).select(
        "page_id", "text_length", "html_length"
    )


def page_summary(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_summary(read_pages(spark, sf)).select(
        "page_id",
        "url",
        "title",
        "text_length",
        F.size("headings").alias("heading_count"),
        F.size("links").alias("link_count"),
    )


def same_origin_links(spark: SparkSession, sf: str) -> DataFrame:
    found = unnest(
        read_pages(spark, sf),
        ["page_id", urls.url_origin(F.col("url")).alias("origin")],
        pages.links(pages.markup(F.col("html")), F.col("url")),
    )
    return found.where(urls.url_origin(F.col("url")) == F.col("origin")).select("page_id", "url")


def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Page URLs in upper-cased, port-carrying and scheme-less spellings."""
    rest = F.regexp_replace("url", "^https?://", "")
    host, path = F.regexp_extract(rest, "^[^/]*", 0), F.regexp_replace(rest, "^[^/]*", "")
    form = F.col("page_id") % 4
    raw = (
        F.when(form == 0, F.concat(F.lit(" HTTPS://"), F.upper(host), F.lit(":443"), path))
        .when(form == 1, F.concat(host, path))
        .when(form == 2, F.concat(F.lit("ftp://"), host, path))
        .otherwise(F.concat(F.lit("http://"), host, F.lit("/x/.."), path))
    )
    return (
        read_table(spark, sf, "pages")
        .select("page_id", raw.alias("raw"))
        .select("page_id", urls.normalize_url(F.col("raw")).alias("url"), urls.normalize_error(F.col("raw")).alias("message"))
    )


def url_origin(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return read_table(spark, sf, "pages").select(
        "page_id",
        urls.url_origin(u).alias("origin"),
        urls.url_host(u).alias("host"),
        urls.last_segment(u).alias("last_segment"),
    )


def text_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", tx.truncate(F.col("text"), 200).alias("preview"))


def node_counts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        dom.nodes(read_pages(spark, sf)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))
    )


def selector_match(spark: SparkSession, sf: str) -> DataFrame:
    return select.selector_match(read_pages(spark, sf), "nav li > a[href^='/t']").select("page_id", "text")


def selector_list(spark: SparkSession, sf: str) -> DataFrame:
    found = select.selector_match(read_pages(spark, sf), "div.ad, article h1, html > body > footer")
    return found.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        page_scan,
        page_title,
        page_headings,
        page_links,
        page_text,
        page_text_scoped,
        page_lengths,
        page_summary,
        same_origin_links,
        url_normalize,
        url_origin,
        text_truncate,
        node_counts,
        selector_match,
        selector_list,
    )
}

# ------------------------------------------------------------------ expected

def _unescape(sql: str) -> str:
    """Entities that occur in the given pages; the ampersand comes last."""
    sql = f"replace(replace(replace({sql}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·')"
    return f"regexp_replace({sql}, '&amp;?', '&', 'g')"


def _trim(sql: str) -> str:
    return f"regexp_replace({sql}, '^\\s+|\\s+$', '', 'g')"


def _collapse(sql: str) -> str:
    sql = f"regexp_replace(replace({sql}, chr(13), ''), '[ \\t\\x{{00A0}}]+', ' ', 'g')"
    sql = f"regexp_replace({sql}, ' ?\\n ?', chr(10), 'g')"
    return _trim(f"regexp_replace({sql}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


# Paragraphs of an article: an unclosed one ends where the next begins, or with
# the article.
_CLOSED = """
    array_to_string(list_transform(string_split(html, '<p>'), lambda s, i:
        CASE WHEN i = 1 OR contains(s, '</p>') THEN s
             WHEN contains(s, '</article>') THEN replace(s, '</article>', '</p></article>')
             ELSE s || '</p>' END), '<p>')"""


def _visible(sql: str) -> str:
    sql = f"regexp_replace({sql}, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"
    return sql


def _readable(sql: str) -> str:
    sql = f"regexp_replace({sql}, '<br>|</p>|</div>|</article>|</li>|</h1>', chr(10), 'g')"
    return _collapse(_unescape(f"regexp_replace({sql}, '<[^>]*>', '', 'g')"))


_BODY = "regexp_extract(closed, '(?s)<body>(.*)', 1)"
_PAGES = f"(SELECT page_id, url, html, {_CLOSED} AS closed FROM (SELECT page_id, url, {_visible('html')} AS html FROM pages))"
_TITLE = _trim(_unescape("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))


def _encode(sql: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({sql}, ''), lambda c: "
        "CASE WHEN regexp_matches(c, '[^\\x21-\\x7e]|[\"<>`{}]') THEN url_encode(c) ELSE c END), '')"
    )


_LINKS = f"""
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, text, url, origin
    FROM (
        SELECT page_id, min(pos) AS pos, arg_min(text, pos) AS text, url, any_value(origin) AS origin
        FROM (
            SELECT page_id, pos, origin, {_collapse(_unescape("regexp_extract(a, '>(.*)<', 1)"))} AS text,
                   origin || {_encode(_unescape("regexp_extract(a, 'href=\"([^\"]*)\"', 1)"))} AS url
            FROM (
                SELECT page_id, regexp_extract(url, '^https?://[^/]*') AS origin,
                       unnest(regexp_extract_all(html, '(?s)<a href=.*?</a>')) AS a,
                       generate_subscripts(regexp_extract_all(html, '(?s)<a href=.*?</a>'), 1) AS pos
                FROM pages)
        ) GROUP BY page_id, url
    )"""

ORACLE = {
    "page_scan": "SELECT page_id, url, CAST(length(html) AS INTEGER) AS html_length FROM pages",
    "page_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "page_headings": f"""
        SELECT page_id, CAST(0 AS INTEGER) AS pos, CAST(1 AS INTEGER) AS level, text FROM (
            SELECT page_id, {_collapse(_unescape("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS text FROM pages)
        WHERE text <> ''""",
    "page_links": f"SELECT page_id, pos, text, url FROM ({_LINKS})",
    "page_text": f"SELECT page_id, {_readable(_BODY)} AS text FROM {_PAGES}",
    "page_text_scoped": "SELECT page_id, "
    + _readable("regexp_extract(closed, '(?s)<article.*</article>')")
    + f" AS text FROM {_PAGES}",
    "page_lengths": f"""
        SELECT page_id, CAST(length({_readable(_BODY)}) AS INTEGER) AS text_length,
               CAST(html_length AS INTEGER) AS html_length
        FROM {_PAGES} JOIN (SELECT page_id, length(html) AS html_length FROM pages) USING (page_id)""",
    "page_summary": f"""
        SELECT page_id, url, {_TITLE} AS title,
               CAST(length({_readable(_BODY)}) AS INTEGER) AS text_length,
               CAST(CASE WHEN {_collapse("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} = '' THEN 0 ELSE 1 END AS INTEGER) AS heading_count,
               CAST(coalesce(link_count, 0) AS INTEGER) AS link_count
        FROM {_PAGES} LEFT JOIN (SELECT page_id, count(*) AS link_count FROM ({_LINKS}) GROUP BY page_id) USING (page_id)""",
    "same_origin_links": f"SELECT page_id, url FROM ({_LINKS})",
    "url_normalize": """
        SELECT page_id,
               CASE page_id % 4 WHEN 0 THEN 'https://' || lower(host) || path
                                WHEN 1 THEN 'https://' || host || path
                                WHEN 3 THEN 'http://' || host || path END AS url,
               CASE page_id % 4 WHEN 2 THEN 'Only http/https URLs are supported, got "ftp:"' END AS message
        FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host,
                     regexp_replace(url, '^https?://[^/]*', '') AS path FROM pages)""",
    "url_origin": """
        SELECT page_id, regexp_extract(url, '^https?://[^/]*') AS origin,
               regexp_extract(url, '^https?://([^/:]*)', 1) AS host,
               nullif(list_filter(string_split(regexp_extract(url, '^https?://[^/]*([^?#]*)', 1), '/'), lambda s: s <> '')[-1], '') AS last_segment
        FROM pages""",
    "text_truncate": """
        SELECT doc_id, CASE WHEN length(text) > 200
            THEN left(text, 200) || chr(10) || chr(10) || '…[truncated ' || (length(text) - 200) || ' more characters]'
            ELSE text END AS preview FROM documents""",
    "node_counts": f"""
        SELECT page_id, tag, count(*) AS n FROM (
            SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS tag
            FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
                                                 '(?s)(<script>|<style>).*?(</script>|</style>)', '\\1', 'g') AS html FROM pages))
        GROUP BY page_id, tag""",
    "selector_match": f"""
        SELECT page_id, {_unescape("regexp_extract(a, '<a[^>]*>(.*)<', 1)")} AS text
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li><a href="/t.*?</a>')) AS a FROM pages)
        WHERE a <> ''""",
    "selector_list": """
        SELECT page_id, tag, count(*) AS n FROM (
            SELECT page_id, unnest(regexp_extract_all(html, '<(div|h1|footer)[ >]', 1)) AS tag FROM pages)
        GROUP BY page_id, tag""",
}
