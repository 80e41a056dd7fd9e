from pyspark.sql import functions as F

from pageloom.functions import contacts, media, prices, text, urls

PRICES = {
    "250,00 TL": 250.0, "1.199,90 TL": 1199.9, "1.500 TL": 1500.0, "₺89,99": 89.99, "$1,299.00": 1299.0,
    "$199.99": 199.99, "1,500": 1500.0, "€1.234.567,89": 1234567.89, "49 TL": 49.0, "0,50": 0.5, "none": None,
}
CURRENCIES = {
    "₺ 2,999.00": "TRY", "1.499,50 ₺": "TRY", "250,00 TL": "TRY", "1.299,00 TRY": "TRY", "$199.99": "USD",
    "€49,90": "EUR", "£19.99": "GBP", "12 chf": "CHF", "no price here": None,
}


def test_all_entity_names(evaluate):
    """What the JVM reads of every name of the HTML standard, whole or cut short, is what the tree reads."""
    from html import unescape as tree
    from html.entities import html5

    cases = [f"x&{n}y&{n}" for n in html5] + [f"&{n[:-2]};=" for n in list(html5)[::7]] + ["&notit;", "&notin;", "&copyright", "&AMPx", "&ampx;"]
    assert evaluate(cases, text.unescape) == [tree(c) for c in cases]


def test_prices(evaluate):
    assert evaluate(PRICES, prices.price_value) == list(PRICES.values())
    assert evaluate(CURRENCIES, prices.currency) == list(CURRENCIES.values())
    assert evaluate(["now $5 12 only", "12,50 TL", "x 1 299,90 TL", "-"], prices.price_text) == [
        "$5 12", "12,50 TL", "299,90 TL", None,
    ]


def test_normalize_url(evaluate):
    cases = {
        " Shop.Test ": "https://shop.test/",
        "HTTP://A.test:80/x/./y/../z?q#f": "http://a.test/x/z?q#f",
        "https://a.test:8443": "https://a.test:8443/",
        "https://a.test/für x": "https://a.test/f%C3%BCr%20x",
        "https://a.test/%zz": "https://a.test/%zz",
        "https://a.test/a/..": "https://a.test/",
        "https://a.test/a/.hidden": "https://a.test/a/.hidden",
        "ftp://example.com/file": None,
        "https://": None,
        "http://a b/": None,
        "http://a:99999/": None,
    }
    assert evaluate(cases, urls.normalize_url) == list(cases.values())


def test_resolve_url(evaluate):
    base = urls.base_parts(F.lit("https://M.test/en/d/25?k=v#top"))
    cases = {
        "/x": "https://m.test/x", "//o.test/y": "https://o.test/y", "../z": "https://m.test/en/z",
        "?q=1": "https://m.test/en/d/25?q=1", "#f": "https://m.test/en/d/25?k=v#f", "#": None,
        "javascript:go()": None, " ": None, "mailto:a@b.test": "mailto:a@b.test", "a/../../../../b": "https://m.test/b",
        "https://Q.test": "https://q.test/", "./": "https://m.test/en/d/", "DATA:image/png,x": "data:image/png,x",
    }
    assert evaluate(cases, lambda c: urls.resolve(c, base)) == list(cases.values())


def test_url_parts(evaluate):
    u = ["https://a.test:444/x/y.png/?q", "https://user@b.test/", "mailto:x"]
    assert evaluate(u, urls.url_origin) == ["https://a.test:444", "https://b.test", None]
    assert evaluate(u, urls.url_host) == ["a.test", "b.test", None]
    assert evaluate(u, urls.last_segment) == ["y.png", None, None]
    assert evaluate(["https://a.test/x#1", "https://A.test/x"], urls.fetch_key) == ["https://a.test/x"] * 2


def test_entities(evaluate):
    cases = {
        "a &amp;lt; b": "a &lt; b", "&copy 1": "© 1", "&#8364;&#x20AC;&#x80;": "€€€", "&bogus; &am": "&bogus; &am",
        "&nbsp;|": " |", "&#0;&#55296;": "��", "none": "none", "&Auml;&alpha;&apos;": "Äα'",
        "&ampx &lt": "&x <", "&#x1F600;": "😀",
    }
    assert evaluate(cases, text.unescape) == list(cases.values())


def test_whitespace(evaluate):
    assert evaluate(["　 a\t  b \r\n \n\n\n c﻿"], text.collapse) == ["a b\n\nc"]
    assert evaluate([" a\n  b "], text.squash) == ["a b"]
    assert evaluate(["abcdef", "abc"], lambda c: text.truncate(c, 3)) == ["abc\n\n…[truncated 3 more characters]", "abc"]


def test_readable_text(evaluate):
    cases = {
        "<p>A<p>B<div>C<br>D</div><ul><li>1<li>2</ul><script>'</p>'</script><!-- <p>x -->": "A\nB\nC\nD\n1\n2",
        "<html><head><title>T</title></head><body><h1>x</h1>y</body>": "x\ny",
        "<title>only</title>": "only",
        "<body></body>": "",
        '<a title="a>b">x</a> 1 < 2 <img alt=\'>\'>z': "x 1 < 2 z",
        "<table><tr><td>1<td>2<tr><td>3</table>": "12\n3",
        "a<noscript>n</noscript><svg><title>s</title></svg>b": "ab",
    }
    assert evaluate(cases, text.readable_text) == list(cases.values())


def test_attribute(evaluate):
    tags = ['<a title="x href=no" HREF = "/q?a=1&amp;b=2">', "<a href=/x>", "<a data-href='n' href>", "<a href=''>"]
    assert evaluate(tags, lambda c: text.attribute(c, "href")) == ["/q?a=1&b=2", "/x", None, ""]


def test_emails(evaluate):
    cases = {
        "'Info@Shop.Test.": "info@shop.test", "a@example.com": None, "a@mail.example.com": None, "logo@2x.png": None,
        "v@1.2.3": None, "0123456789abcdef0@t.co": None, "a@localhost": None, "plain": None, "x@notexample.com": "x@notexample.com",
    }
    assert evaluate(cases, contacts.clean_email) == list(cases.values())
    assert evaluate(["x a@b.co,c@d.org. e@f"], contacts.scan_emails) == [["a@b.co", "c@d.org"]]
    assert evaluate(["a@b.com.x@y.com"], contacts.scan_emails) == [["a@b.com", ".x@y.com"]]


def test_email_scan_is_linear(evaluate):
    """A megabyte without an at sign inside, as inlined images have."""
    assert evaluate(["A" * 1_000_000 + " a@b.co"], contacts.scan_emails) == [["a@b.co"]]


def test_deobfuscate(evaluate):
    cases = {
        "info [at] x [dot] com": "info@x.com", "info(ät)x{punkt}com": "info@x.com", "a at b.com": "a@b.com",
        "meet at noon": "meet at noon", "a at b (dot) com": "a@b.com", "x nokta y": "x.y",
    }
    assert evaluate(cases, contacts.deobfuscate) == list(cases.values())


def test_phones(evaluate):
    cases = {
        "+90 212 123 45 67": "+902121234567", "0090 212 123 45 67": "+902121234567", "0532 987 65 43": "05329876543",
        "8471294": None, "2024-11-05": None, "1111111": None, "12345678": None, "987654321": None, "123 456": None,
        "(212) 55512": "21255512", "5321234567": "5321234567", "1234567890123456": None,
    }
    assert evaluate(cases, contacts.normalize_phone) == list(cases.values())


def test_mailto(evaluate):
    links = ["mailto:a@b.co,c%2Bd@e.co?subject=x,y", "MAILTO:bad%zz@x.co", "mailto:a+b@c.co;d@e.co"]
    assert evaluate(links, contacts.mailto_addresses) == [["a@b.co", "c+d@e.co"], [], ["a+b@c.co", "d@e.co"]]


def test_social(evaluate):
    cases = {
        "https://www.facebook.com/x": "facebook", "https://FB.com/x": "facebook", "https://twitter.com/x": "x",
        "https://tr.linkedin.com/in/me": "linkedin", "https://linkedin.com/feed/": None, "https://t.me/x": "telegram",
        "https://www.tiktok.com/@me": "tiktok", "https://youtube.com/watch?v=1": None, "https://instagram.com/": None,
    }
    assert evaluate(cases, contacts.social_network) == list(cases.values())


def test_contact_labels(evaluate):
    labels = ["CONTACT us", "Bize Ulaşın /iletisim", "İletişim", "ILETIŞIM", "hakkında", "news", "our TEAM"]
    assert evaluate(labels, contacts.is_contact_label) == [True, True, False, True, True, False, True]


def test_srcset(evaluate):
    cases = {
        "/a.png 300w, /b.png 1200w": "/b.png", "/a 1x, /b 2x": "/b", "/only": "/only", "/a 1x, /b 1x": "/a",
        "/a 1.5x,/b 1400w": "/a", " , ": None,
    }
    assert evaluate(cases, media.srcset_best) == list(cases.values())


def test_data_uri(evaluate):
    got = evaluate(["data:image/png;base64,aGk%3D", "data:text/plain,a%20b", "data:nope"], media.data_uri)
    assert [(g.ok, g.content_type, bytes(g.content)) for g in got[:2]] == [(True, "image/png", b"hi"), (True, "text/plain", b"a b")]
    assert got[2].ok is False


def test_image_names(evaluate):
    def name(c):
        return media.image_file_name(c, F.lit("image/webp; x"), F.lit(7))

    urls_ = ["https://a.test/x/Grü%C3%9Fe%20du.JPG?x", "https://a.test/", "data:image/png,x", "https://a.test/%zz"]
    assert evaluate(urls_, name) == ["007-Gr-e-du.webp", "007-image.webp", "007-image.webp", "007-image.webp"]
    big = evaluate(["https://a.test/" + "n" * 80 + ".png"], lambda c: media.image_file_name(c, F.lit(""), F.lit(1234)))
    assert big == ["1234-" + "n" * 60 + ".jpg"]
