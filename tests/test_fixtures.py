"""The fixture site, end to end."""

import fixture_pages as fx
import pytest
from pyspark.sql import functions as F

from pageloom.operators import crawl, images, inspect, leads, lists, pages, paginate


def test_page_summary(spark):
    row = pages.page_summary(fx.pages_df(spark, [2])).first()
    assert row.title == "Kontakt | Möwe Bootsbedarf" and row.description == "So erreichen Sie den Laden am Kai"
    assert "werft@moewe-boot.de" in row.text and row.text_length == len(row.text)
    assert [(h.level, h.text) for h in row.headings] == [(1, "Der Laden am Kai"), (2, "Schreiben"), (2, "Rufen")]
    assert [link.url for link in row.links][:2] == ["mailto:laden@moewe-boot.de?subject=Frage", "tel:+4940300600900"]
    assert row.html_length == len(fx.CONTACT)


def test_scoped_summary(spark):
    df = fx.pages_df(spark, [2, 9])
    row = pages.page_summary(df, selector="address", include_html=True, include_links=False).collect()
    assert [(r.page_id, r.text) for r in row] == [(2, "Kaiweg 12, 20457 Hafenstadt")]
    assert row[0].html.startswith("<address>") and "links" not in row[0]
    assert [r.target_id for r in pages.scope_errors(df, "address").collect()] == [9]


def test_odd_links(spark):
    urls = [r.url for r in pages.page_links(fx.pages_df(spark, [10])).orderBy("pos").collect()]
    assert urls == [
        "https://cdn.test/z", f"{fx.BASE}/up", f"{fx.BASE}/odd/page?q=1", "mailto:broken%zz@x.co", "mailto:ok%2Btag@x.co",
    ]


def test_leads_over_contact_pages(spark):
    rows = leads.site_leads(fx.target_df(spark), fx.pages_df(spark), max_pages=3).collect()
    by = {k: {r.value for r in rows if r.kind == k} for k in ("email", "phone", "address")}
    assert by["email"] == {"laden@moewe-boot.de", "werft@moewe-boot.de", "lager@moewe-boot.de"}
    assert "+4940300600900" in by["phone"] and any(p.endswith("1715550123") for p in by["phone"])
    assert not any("5530172" in p for p in by["phone"])
    assert {r.network for r in rows if r.kind == "social"} == {"facebook", "youtube"}
    assert by["address"] == {"Kaiweg 12, 20457 Hafenstadt"}
    tel = next(r for r in rows if r.value == "+4940300600900")
    assert tel.source == "tel-link" and tel.first_url == f"{fx.BASE}/kontakt"


def test_walk_follows_only_contact_pages(spark):
    visits = crawl.walk_contacts(fx.target_df(spark), fx.pages_df(spark), 3).orderBy("visit").collect()
    assert [v.page_url for v in visits] == [f"{fx.BASE}/", f"{fx.BASE}/kontakt"]
    alone = crawl.walk_contacts(fx.target_df(spark), fx.pages_df(spark), 1).collect()
    assert [v.page_id for v in alone] == [1]


def test_walk_rules(spark):
    """Queue order, misses that free their place, own origin, and the page limit."""

    def links(*hrefs):
        return "".join(f'<a href="{h}">contact</a>' for h in hrefs)

    site = [
        (1, "https://a.test/", links("/x", "/gone", "https://b.test/about", "/y", "/z")),
        (2, "https://a.test/x", links("/", "/deep", "/y")),
        (3, "https://a.test/y", links("/late")),
        (4, "https://a.test/z", ""),
        (5, "https://a.test/deep", ""),
        (6, "https://a.test/late", ""),
    ]
    df = spark.createDataFrame(site, "page_id long, url string, html string")
    targets = spark.createDataFrame([(7, "a.test"), (8, "https://a.test/"), (9, "https://gone.test")], "target_id long, url string")

    def walk(limit):
        rows = crawl.walk_contacts(targets, df, limit).collect()
        assert {r.target_id for r in rows} == {7, 8}
        return [r.page_id for r in sorted(rows, key=lambda r: r.visit) if r.target_id == 7]

    assert walk(2) == [1, 2]
    # Room for two: /x and /gone are queued. /x adds nothing (queue is full);
    # /gone was not captured, and then the queue is empty.
    assert walk(3) == [1, 2]
    # /x, /gone and /y queued; the miss is not replaced until a visit adds links.
    assert walk(4) == [1, 2, 3, 6]
    assert walk(10) == [1, 2, 3, 4, 5, 6]
    assert [(e.target_id, e.op) for e in crawl.walk_errors(targets, df).collect()] == [(9, "leads")]


def test_catalogue_over_all_pages(spark):
    found = paginate.extract_list(fx.target_df(spark, "/sortiment?seite=1"), fx.pages_df(spark), max_pages=99)
    rows = found.items.orderBy("item_no").collect()
    assert [r.title for r in rows] == list(fx.GOODS)
    last = rows[-1]
    assert (last.price, last.price_value, last.currency) == ("128,50 €", 128.5, "EUR")
    assert last.link == f"{fx.BASE}/ware/011" and last.image == f"{fx.BASE}/bilder/011@2.jpg"
    summary = found.summary.first()
    assert (summary.selector, summary.auto_detected, summary.item_count) == ("li.product", True, 12)
    assert len(summary.pages_scraped) == 4
    assert found.errors.count() == 0
    two = paginate.extract_list(fx.target_df(spark, "/sortiment?seite=1"), fx.pages_df(spark), max_pages=2)
    assert two.items.count() == 6
    few = paginate.extract_list(fx.target_df(spark, "/sortiment?seite=1"), fx.pages_df(spark), max_pages=4, max_items=5)
    assert few.items.count() == 5


def test_field_specs(spark):
    fields = {"ware": {"selector": "h4"}, "preis": {"selector": "b"}, "seite": {"selector": "p > a", "attr": "href"}}
    found = paginate.extract_list(
        fx.target_df(spark, "/sortiment?seite=2"), fx.pages_df(spark), item_selector="ol > li", fields=fields
    )
    rows = found.items.orderBy("item_no").collect()
    assert [(r.ware, r.preis) for r in rows] == [("Lenzpumpe", "40,50 €"), ("Kompass", "51,50 €"), ("Klampe", "62,50 €")]
    assert rows[2].seite == f"{fx.BASE}/ware/005"


def test_table_rows(spark):
    rows = lists.extract_items(fx.pages_df(spark, [8]), "table tbody tr").orderBy("item_idx").collect()
    assert [r["values"] for r in rows] == [
        {"Steg": "Nord", "Länge": "9 m", "Tiefe": "2,1 m", "Saison": "£840.00"},
        {"Steg": "Süd", "Länge": "14 m", "Tiefe": "3,0 m", "Saison": "£1,410.50"},
    ]
    assert rows[0]["keys"] == ["Steg", "Länge", "Tiefe", "Saison"]


def test_odd_tables(spark):
    html = """<table><tr><th>A<th>A<th></tr><tr><td>1<td>2<td><a href="/x">3</a><td>4</tr><tr></tr><tr><td> </tr></table>
    <table><tr><td>p<td>q</table>"""
    df = spark.createDataFrame([(1, "https://a.test/", html)], "page_id long, url string, html string")
    rows = lists.extract_items(df, "table tbody tr").orderBy("item_idx").collect()
    assert [dict(r["values"]) for r in rows] == [
        {"A": "A", "column_3": ""},
        {"A": "2", "column_3": "3", "column_3_link": "https://a.test/x", "column_4": "4"},
        {"column_1": "p", "column_2": "q"},
    ]


def test_shelves_are_not_detected_but_suggested(spark):
    df = fx.pages_df(spark, [7])
    failed = paginate.extract_list(fx.target_df(spark, "/regal/"), df)
    assert failed.items.count() == 0
    assert failed.errors.first().message.startswith("No known selector")
    best = inspect.suggest_selectors(df).orderBy("rank").first()
    assert (best.selector, best["count"]) == ("figure.fach_a7", 6)
    assert (best.with_link, best.with_image, best.with_price) == (100, 100, 100)
    assert best.sample_titles[0] == "Segeltuch Nr. 2 60,00 € mehr"
    page = inspect.inspect_pages(df).first()
    assert page.json_ld_products == 2 and "fach_a7" in page.hint
    rows = paginate.extract_list(fx.target_df(spark, "/regal/"), df, item_selector=best.selector).items.orderBy("item_no").collect()
    assert [r.price_value for r in rows] == [60.0, 90.0, 120.0, 150.0, 180.0, 210.0] and rows[5].link == f"{fx.BASE}/regal/tuch-7.html"


def test_no_list_hint(spark):
    assert inspect.inspect_pages(fx.pages_df(spark, [1])).first().hint.startswith("Nothing repeats")


def test_photographs(spark):
    """By area; markup in noscript and template is no image, what follows an empty comment is."""
    df = fx.pages_df(spark, [9])
    kept = images.image_candidates(df, 150, 150).orderBy("rank").collect()
    assert [k.url.removeprefix(f"{fx.BASE}/fotos/foto/") for k in kept] == ["kran.jpg", "flut.jpg", "nach.jpg", "leer.gif", "mole.jpg"]
    skipped = images.size_skips(df, 150, 150).collect()
    assert [(s.url, s.reason) for s in skipped] == [(f"{fx.BASE}/fotos/foto/punkt.gif", "below 150x150 (24x24)")]


def test_more_than_a_browser_tool_takes(spark):
    """What the old fixed limits would have cut."""
    many = "".join(f"<h2>Titel {i}</h2>" for i in range(300)) + "".join(f'<a href="/x/{i}">{"lang " * 60}</a>' for i in range(1500))
    many += "".join(f'<img src="/i/{i}.png" width="500" height="{400 + i}">' for i in range(150)) + '<b class="tok">x</b>' * 3000
    many += "".join(f'<div class="card">{"nur Text" if i < 50 else f"<a href=/k/{i}>Karte {i}</a> {i},00 €"}</div>' for i in range(60))
    df = spark.createDataFrame([(1, "https://a.test/", many)], "page_id long, url string, html string")
    assert pages.page_headings(df).count() == 300 and pages.page_headings(df, 200).count() == 200
    found = pages.page_links(df)
    assert found.count() == 1510 and found.where("length(text) = 299").count() == 1500
    assert pages.page_links(df, 10, 4).select("text").distinct().collect()[0].text == "lang"
    assert {r.selector: r["count"] for r in inspect.class_counts(df).collect()}["b.tok"] == 3000
    assert lists.detect_selectors(df).first().selector == ".card" and lists.detect_selectors(df, 40).first().selector is None
    candidates = images.image_candidates(df)
    stored = [(f"https://a.test/i/{i}.png", 404 if i >= 50 else 200, "image/png", bytes([i]) * 2000) for i in range(150)]
    stored = spark.createDataFrame(stored, "url string, status int, content_type string, content binary")
    assert images.judged_images(candidates, stored).where("reason is null").count() == 50
    assert images.judged_images(candidates, stored, 20).where("reason is null").count() == 20
    with pytest.raises(ValueError):
        pages.page_links(df, 0)


def test_long_walks(spark):
    hops = [(i, f"https://w.test/contact/{i}", f'<a href="/contact/{i + 1}">contact</a><p>a{i}@mail{i}.de</p>') for i in range(12)]
    rows = [(100 + i, f"https://w.test/list?p={i}", f'<a rel="next" href="?p={i + 1}">next</a><ul>' + "".join(f'<li class="product"><a href="/{i}/{k}">Ware {i} {k}</a> 1,00 €</li>' for k in range(4)) + "</ul>") for i in range(60)]
    df = spark.createDataFrame(hops + rows, "page_id long, url string, html string")
    start = spark.createDataFrame([(1, "https://w.test/contact/0")], "target_id long, url string")
    assert crawl.walk_contacts(start, df, None).count() == 12 and crawl.walk_contacts(start, df, 11).count() == 11
    start = spark.createDataFrame([(1, "https://w.test/list?p=0")], "target_id long, url string")
    found = paginate.extract_list(start, df, max_pages=80)
    assert found.items.count() == 240 and found.summary.first().page_count == 60


def test_walk_reads_its_own_sites_only(spark):
    """Pages of other origins go before any pattern looks at their markup."""
    from pageloom.operators.leads import contact_edges
    from pageloom.functions import urls

    site = [(1, "https://a.test/", '<a href="/contact">contact</a>'), (2, "https://a.test/contact", ""), (3, "https://b.test/contact", "")]
    df = spark.createDataFrame(site, "page_id long, url string, html string")
    target = spark.createDataFrame([(1, "https://a.test/")], "target_id long, url string")
    assert sorted(r.page_id for r in crawl.walk_contacts(target, df, None).collect()) == [1, 2]
    own = df.join(F.broadcast(target.select(urls.url_origin(F.col("url")).alias("o"))), urls.url_origin(F.col("url")) == F.col("o"), "left_semi")
    plan = contact_edges(own)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("candidates") < plan.index("LeftSemi")


def test_watermarked_stream(spark, tmp_path):
    from pageloom.streaming import incremental

    rows = [(1, "https://a.test/", '<a href="/x">x</a>', None, 200, "2024-01-01 00:00:00"), (2, "https://a.test/2", '<a href="/x">x</a><a href=y>y</a>', "https://b.test/", 200, "2024-01-01 00:01:00")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, final_url string, status int, captured_at string")
    df.withColumn("captured_at", F.col("captured_at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = incremental.page_stream(spark, str(tmp_path / "in"), keep_for="1 day")
    query = incremental.extract_stream(stream, incremental.distinct_links, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["https://a.test/x", "https://b.test/x", "https://b.test/y"]


def test_redirects(spark):
    rows = [(1, "https://a.test/old", "https://b.test/new/", 200, "<a href=x>x</a>"), (2, "https://a.test/q", None, 404, "<a href=x>x</a>")]
    df = spark.createDataFrame(rows, "page_id long, url string, final_url string, status int, html string")
    assert [r.url for r in pages.page_links(df).orderBy("page_id").collect()] == ["https://b.test/new/x", "https://a.test/x"]
    row = pages.page_summary(df).orderBy("page_id").first()
    assert (row.final_url, row.status, row.links[0].url) == ("https://b.test/new/", 200, "https://b.test/new/x")


def test_image_store(spark):
    big, other = b"x" * 2000, b"y" * 2000
    import base64

    inline = "data:image/gif;base64," + base64.b64encode(other).decode()
    cands = [(1, i + 1, u, None, None, "") for i, u in enumerate(
        ["https://a.test/1.png", "https://a.test/2.png", "https://a.test/404", "https://a.test/html", "https://a.test/tiny", inline, "data:bad", "https://a.test/none"])]
    candidates = spark.createDataFrame(cands, "page_id long, rank int, url string, width int, height int, alt string")
    data = [
        ("https://a.test/1.png", 200, "image/png", big), ("https://a.test/2.png", 200, "image/png", big),
        ("https://a.test/404", 404, "text/html", b""), ("https://a.test/html", 200, "text/html", big),
        ("https://a.test/tiny", 200, "image/png", b"z"), ("https://a.test/1.png", 200, "image/png", big),
    ]
    stored = spark.createDataFrame(data, "url string, status int, content_type string, content binary")
    kept = images.image_store(candidates, stored).orderBy("rank").collect()
    assert [(k.file_name, bytes(k.content)) for k in kept] == [("001-1.png", big), ("002-image.gif", other)]
    reasons = [r.reason for r in images.judged_images(candidates, stored).orderBy("rank").collect()]
    assert reasons == [None, "duplicate content", "HTTP 404", "not an image (text/html)", "too small (1 bytes)", None, "unparsable data URI", "not captured"]
    one = images.judged_images(candidates, stored, max_images=1).collect()
    assert len(one) == 1


@pytest.mark.parametrize("parts", [1, 17])
def test_order_does_not_matter(spark, parts):
    """Same rows whatever the partitioning."""
    df = fx.pages_df(spark).repartition(parts)
    summary = pages.page_summary(df).select("page_id", "text", F.to_json("links").alias("l"))
    found = paginate.extract_list(fx.target_df(spark, "/sortiment?seite=1"), df, max_pages=3).items
    lead = leads.site_leads(fx.target_df(spark), df, 3)
    key = (
        sorted(map(str, summary.collect())),
        sorted(str(r.asDict()) for r in found.collect()),
        sorted(str(r.asDict()) for r in lead.collect()),
    )
    assert _SEEN.setdefault("key", key) == key


_SEEN: dict = {}


def test_options_of_each_target(spark):
    """Selectors, fields and limits as columns; a target that can't be used says why and stops no other."""
    named = [("ware", "h4", None, None), ("nummer", "a", "href", r"(\d+)$")]
    rows = [
        (1, f"{fx.BASE}/sortiment?seite=1", "ol > li", 2, None, named),
        (2, f"{fx.BASE}/sortiment?seite=1", None, 4, 5, None),
        (3, f"{fx.BASE}/sortiment?seite=1", "li:hover", 1, None, None),
        (4, f"{fx.BASE}/liegeplaetze", "table tbody tr", None, None, None),
        (5, f"{fx.BASE}/sortiment?seite=1", "li.product", 0, None, None),
    ]
    field = "array<struct<name: string, selector: string, attr: string, regex: string>>"
    targets = spark.createDataFrame(rows, f"target_id long, url string, item_selector string, max_pages int, max_items int, fields {field}")
    found = paginate.extract_list(targets, fx.pages_df(spark))
    by = {}
    for r in found.items.orderBy("target_id", "item_no").collect():
        by.setdefault(r.target_id, []).append(r)
    assert [r.fields["ware"] for r in by[1]][:3] == list(fx.GOODS)[:3] and len(by[1]) == 6 and by[1][5].fields["nummer"] == "005"
    assert [r.title for r in by[2]] == list(fx.GOODS)[:5] and by[2][0].fields is None
    assert [r["values"]["Steg"] for r in by[4]] == ["Nord", "Süd"]
    problems = {r.target_id: r.message for r in found.errors.collect()}
    assert set(problems) == {3, 5} and "hover" in problems[3] and "at least 1" in problems[5]
