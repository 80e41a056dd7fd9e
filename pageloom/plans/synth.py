"""Captured pages made from the given tables.

The given pages hold no products, tables, prices or contact links. These
helpers write rows of the other tables as markup, so that extraction has to give
the rows back. Page sizes are fixed; the number of pages grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.session import settle
from pageloom.sources.captured import read_table, spread

PER_PAGE = 20
PAGES_PER_SHOP = 5
SHOP = "https://shop.test"


def shown_price(cents: Column) -> Column:
    """English style for even amounts of cents, Turkish style for odd ones."""
    fraction = F.lpad((cents % 100).cast("string"), 2, "0")
    english = F.format_number(F.floor(cents / 100).cast("long"), 0)
    return F.when(
        cents % 2 == 0, F.concat(F.lit("$"), english, F.lit("."), fraction)
    ).otherwise(F.concat(F.translate(english, ",", "."), F.lit(","), fraction, F.lit(" TL")))


def cents(price: Column) -> Column:
    return F.round(price * 100).cast("long")


def cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def assembled(rows: DataFrame, group: list[str], order: str, piece: Column) -> DataFrame:
    """One row per page with its pieces in order; pages are small by design."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order), piece.alias("piece"))))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, *group).groupBy(*group).agg(
        F.array_join(F.transform(pieces, lambda p: p["piece"]), "\n").alias("body")
    )


def part_card() -> Column:
    key = F.col("p_partkey")
    return cat(
        '<div class="product-card"><h3 class="title">', F.col("p_name"), " ", key, '</h3><span class="price">',
        shown_price(cents(F.col("p_retailprice"))), '</span><a href="/item/', key, '">Details</a><img src="/img/', key,
        '.png" srcset="/img/', key, "-s.png 300w, /img/", key, '-l.png 1200w" alt="', F.col("p_name"), '"></div>',
    )


def brand_card() -> Column:
    """A card that repeats on many pages: only the brand and its link."""
    return cat(
        '<div class="product-card"><h3 class="title">', F.col("p_brand"), '</h3><a href="/brand/',
        F.regexp_replace("p_brand", "#", "-"), '">All</a></div>',
    )


def captured(pages: DataFrame) -> DataFrame:
    """The pages as a stored table, which is what a crawl leaves behind."""
    return settle(pages)


def shop_pages(spark: SparkSession, sf: str, card: Column, next_links: bool = True) -> DataFrame:
    """List pages of ``part``: shops of five pages with twenty cards each."""
    parts = spread(read_table(spark, sf, "part"), "p_partkey").select(
        "*",
        F.floor(F.col("p_partkey") / (PER_PAGE * PAGES_PER_SHOP)).cast("long").alias("shop"),
        (F.floor(F.col("p_partkey") / PER_PAGE) % PAGES_PER_SHOP).cast("int").alias("no"),
    )
    built = assembled(parts, ["shop", "no"], "p_partkey", card)
    address = cat(SHOP + "/s", F.col("shop"), "/list?page=", F.col("no") + 1)
    following = F.when(
        F.lit(next_links) & (F.col("no") < PAGES_PER_SHOP - 1),
        cat('<a rel="next" href="?page=', F.col("no") + 2, '">Next</a>'),
    ).otherwise("")
    return built.select(
        (F.col("shop") * PAGES_PER_SHOP + F.col("no")).alias("page_id"),
        address.alias("url"),
        cat(
            "<html><head><title>Parts</title></head><body><h1>Parts</h1><div class=grid>", F.col("body"),
            '</div><div class="pagination">', following, "</div></body></html>",
        ).alias("html"),
    )


def shop_targets(spark: SparkSession, sf: str) -> DataFrame:
    """One target per shop: its first page."""
    shops = read_table(spark, sf, "part").select(
        F.floor(F.col("p_partkey") / (PER_PAGE * PAGES_PER_SHOP)).cast("long").alias("target_id")
    ).distinct()
    return shops.select("target_id", cat(SHOP + "/s", F.col("target_id"), "/list?page=1").alias("url"))


def shop_pattern() -> Column:
    return cat(SHOP + "/s", F.col("target_id"), "/list?page={page}")


def customer_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as HTML tables of fifty rows, every other one without a header section."""
    customers = spread(read_table(spark, sf, "customer"), "c_custkey").withColumn(
        "page_id", F.floor(F.col("c_custkey") / 50).cast("long")
    )
    row = cat(
        "<tr><td>", F.col("c_custkey"), '<td><a href="/c/', F.col("c_custkey"), '">', F.col("c_name"), "</a><td>",
        F.col("c_mktsegment"), "<td>", shown_price(F.abs(cents(F.col("c_acctbal")))), "</tr>",
    )
    built = assembled(customers, ["page_id"], "c_custkey", row)
    header = "<th>Key<th>Name<th>Segment<th>"
    table = F.when(
        F.col("page_id") % 2 == 0,
        cat("<table><thead><tr>", header, "</thead><tbody>", F.col("body"), "</table>"),
    ).otherwise(cat("<table><tr>", header, "</tr>", F.col("body"), "</table>"))
    return built.select(
        "page_id", cat(SHOP + "/customers/", F.col("page_id")).alias("url"), cat("<body>", table).alias("html")
    )


def supplier_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Four-page sites of the suppliers: home, contact, imprint, and an unlinked page."""
    suppliers = spread(read_table(spark, sf, "supplier"), "s_suppkey")
    key = F.col("s_suppkey")
    host = cat("https://s", key, ".test")
    mail = cat("sales", key, "@s", key, ".shop")
    digits = F.lpad(key.cast("string"), 7, "0")
    home = cat(
        "<html><body><h1>", F.col("s_name"), '</h1><nav><a href="/contact">Contact</a> <a href="/missing-team">Team</a> ',
        '<a href="https://other.test/contact">Contact elsewhere</a> <a href="/products">Products</a> ',
        '<a href="/imprint">Legal</a></nav><p>Mail: info', key, " [at] s", key, " [dot] shop</p></body></html>",
    )
    contact = cat(
        '<html><body><a href="mailto:', mail, "?subject=x\">Write</a> <a href='tel:+90212", digits, "'>Call</a>",
        "<p>Phone: +90 212 ", digits, "</p><address>", F.col("s_name"), " Street ", key,
        ', Istanbul</address><a href="https://www.linkedin.com/company/s', key, '">in</a></body></html>',
    )
    imprint = cat("<html><body><p>Owner: ", mail, "</p><p>Fax (0532) ", digits, "</p></body></html>")
    products = cat("<html><body><p>unlinked", key, "@s", key, ".shop</p></body></html>")
    pages = F.array(
        *[
            F.struct(F.lit(i).alias("no"), cat(host, path).alias("url"), html.alias("html"))
            for i, (path, html) in enumerate(
                [("/", home), ("/contact", contact), ("/imprint", imprint), ("/products", products)]
            )
        ]
    )
    return suppliers.select("s_suppkey", F.inline(pages)).select(
        (F.col("s_suppkey") * 4 + F.col("no")).alias("page_id"), "url", "html"
    )


def supplier_targets(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("target_id"), cat("s", F.col("s_suppkey"), ".test").alias("url")
    )


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def document_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as pages of one paragraph, e-mails moved to a usable domain."""
    docs = spread(read_table(spark, sf, "documents"), "doc_id")
    body = escape(F.replace("text", F.lit(".example.com"), F.lit(".acme.test")))
    return docs.select(
        F.col("doc_id").alias("page_id"),
        cat("https://docs.test/", F.col("doc_id")).alias("url"),
        cat("<html><body><p>", body, "</p></body></html>").alias("html"),
    )


def described_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as pages with descriptions: by name, by property, empty, or none."""
    form = F.col("p_partkey") % 4
    name = F.col("p_name")
    meta = (
        F.when(form == 0, cat('<meta name="description" content="', name, ' &amp; more">'))
        .when(form == 1, cat("<meta content='", name, "' property='og:description'>"))
        .when(
            form == 2,
            cat('<meta name=description content=""><meta property="og:description" content=" ', name, ' ">'),
        )
        .otherwise("")
    )
    return spread(read_table(spark, sf, "part"), "p_partkey").select(
        F.col("p_partkey").alias("page_id"),
        cat(SHOP, "/p/", F.col("p_partkey")).alias("url"),
        cat("<html><head>", meta, "<title>", name, "</title></head><body></body></html>").alias("html"),
    )


def gallery_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as gallery pages, one image channel after the other."""
    parts = spread(read_table(spark, sf, "part"), "p_partkey").withColumn(
        "page_id", F.floor(F.col("p_partkey") / PER_PAGE).cast("long")
    )
    key, form = F.col("p_partkey"), F.col("p_partkey") % 6
    width, height = F.col("p_size") * 20, F.col("p_size") * 10
    piece = (
        F.when(form == 0, cat('<img src="/i/', key, '.png" width="', width, '" height="', height, '" alt="">'))
        .when(
            form == 1,
            cat('<img src="/i/', key, '.png" srcset="/i/', key, '-a.png 1x, /i/', key, '-b.png 2x" width="', width,
                '" height="', height, '" alt="', F.col("p_name"), '">'),
        )
        .when(form == 2, cat('<img data-src="/i/', key, '.png" width="', width, '" height="', height, '" alt="lazy">'))
        .when(form == 3, cat('<picture><source srcset="/i/', key, '.webp 800w"></picture>'))
        .when(form == 4, cat("<div style=\"background-image: url('/i/", key, ".png')\">x</div>"))
        # Seen twice: the larger size and the first description count.
        .otherwise(
            cat('<img src="/i/', key, '.png" width="', width, '" height="10"><img src="/i/', key, '.png" width="10" height="',
                height, '" alt="again">')
        )
    )
    built = assembled(parts, ["page_id"], "p_partkey", piece)
    return built.select(
        "page_id",
        cat(SHOP, "/g/", F.col("page_id")).alias("url"),
        cat('<html><head><meta property="og:image" content="/og/', F.col("page_id"), '.png"></head><body>', F.col("body"),
            "</body></html>").alias("html"),
    )
