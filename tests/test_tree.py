"""Tree rules, and selectors against a plain matcher."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pageloom.operators import dom, select
from pageloom.operators.dom import build_tree
from pageloom.session import settle


def shape(html):
    rows, text = build_tree(html)
    return [(i, r[0], r[2]) for i, r in enumerate(rows)], text.decode()


def tags(html):
    return " ".join(r[2] for r in build_tree(html)[0])


@pytest.mark.parametrize(
    "html, expected",
    [
        ("", "html head body"),
        ("x", "html head body"),
        ("<p>a<p>b", "html head body p p"),
        ("<table><tr><td>1<td>2", "html head body table tbody tr td td"),
        ("<table><td>1", "html head body table tbody tr td"),
        ("<tr><td>x", "html head body"),
        ("<title>t</title><p>x", "html head title body p"),
        ("<ul><li>1<ul><li>2</ul><li>3</ul>", "html head body ul li ul li li"),
        ("</p>x", "html head body p"),
        ("<br/>x</br>", "html head body br br"),
        ("<script>if (a<b) '<p>'</script>", "html head script body"),
        ("<textarea><p></textarea><p>", "html head body textarea p"),
        ("<svg><path/><path/></svg><i>", "html head body svg path path i"),
        ("<!-- <p> --><?php <p> ?><!doctype html>", "html head body"),
        ("<h1>a<h2>b", "html head body h1 h2"),
        ("<dl><dt>a<dd>b<dt>c", "html head body dl dt dd dt"),
        ("<select><option>a<option>b</select>", "html head body select option option"),
        ("<p", "html head body"),
    ],
)
def test_implied_structure(html, expected):
    assert tags(html) == expected


def test_parents():
    rows, _ = shape("<ul><li>1<ul><li>2</ul><li>3</ul><a>x<a>y")
    parents = {i: p for i, p, _ in rows}
    names = [t for _, _, t in rows]
    li = [i for i, t in enumerate(names) if t == "li"]
    assert names[parents[li[0]]] == "ul" and parents[li[2]] == parents[li[0]]
    a = [i for i, t in enumerate(names) if t == "a"]
    assert parents[a[0]] == parents[a[1]]


def test_text_and_entities():
    assert shape("<p title='&lt;'>a &amp; b<script>x&amp;y</script>")[1] == "a & bx&amp;y"
    rows, _ = build_tree("<a HREF='/q?a&amp;b' href=2 checked>")
    assert rows[-1][3] == {"href": "/q?a&b", "checked": ""}


def test_deep_nesting_stays_flat():
    rows, text = build_tree("<div>" * 5000 + "x")
    assert len(rows) == 5003 and text == b"x"


def test_ranges_hold_everywhere():
    rng = random.Random(7)
    pieces = ["<div>", "</div>", "<p>", "</p>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "<b>", "</b>", "t&eacute;", "<br>", "<a href=1>", "<script>q</script>", "</body>", "<h2>", "</h3>"]
    for _ in range(300):
        html = "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))
        rows, text = build_tree(html)
        for i, (parent, stop, *_rest) in enumerate(rows):
            assert parent < i <= stop < len(rows)
            if parent >= 0:
                assert stop <= rows[parent][1]
                assert rows[parent][4] <= rows[i][4] <= rows[i][5] <= rows[parent][5] <= len(text)


SELECTORS = ["div", "*", ".a", ".a.b", "#k", "div .a", "div > p", "ul > li > a", ".a div > p", "[x]", "[x='1']", "[x*=2], p", "p.a, .b > *", "div div div", "[x^='1'] b", "[x$=1]", "[x~=two]", "li a, a"]


def _matches(rows, i, simple):
    row = rows[i]
    for part in simple:
        if part["type"] and part["type"] != "*" and row[2] != part["type"]:
            return False
        if part["cls"] and part["cls"] not in row[3].get("class", "").split():
            return False
        if part["id"] and row[3].get("id") != part["id"]:
            return False
        if part["attr"]:
            have = row[3].get(part["attr"])
            want = part["dq"] or part["sq"] or part["bare"] or ""
            tests = {None: lambda: True, "=": lambda: have == want, "*=": lambda: want in have, "^=": lambda: have.startswith(want), "$=": lambda: have.endswith(want), "~=": lambda: want in have.split()}
            if have is None or not tests[part["op"]]():
                return False
    return True


def _chain(rows, i, steps):
    if not _matches(rows, i, steps[-1][1]):
        return False
    if len(steps) == 1:
        return True
    up = rows[i][0]
    while up >= 0:
        if _chain(rows, up, steps[:-1]):
            return True
        if steps[-1][0] == ">":
            return False
        up = rows[up][0]
    return False


def test_selectors_against_plain_matcher(spark):
    rng = random.Random(3)
    names = ["div", "p", "ul", "li", "a", "b", "i"]
    pages = []
    for n in range(40):
        html = ""
        for _ in range(30):
            tag = rng.choice(names)
            attrs = rng.choice(["", " class=a", ' class="a b"', " class=b", " id=k", " x=1", " x='12'", ' x="two 21"'])
            html += f"<{tag}{attrs}>" if rng.random() < 0.65 else f"</{tag}>"
        pages.append((n, html))
    df = spark.createDataFrame(pages, "page_id long, html string")
    parsed = dom.parse(df)
    got = parsed.select(
        "page_id", *[select.match_ids(F.col("nodes"), s).alias(f"s{i}") for i, s in enumerate(SELECTORS)]
    ).collect()
    for row in got:
        rows, _ = build_tree(pages[row.page_id][1])
        for i, selector in enumerate(SELECTORS):
            steps = select._parse(selector)
            want = [k for k in range(len(rows)) if any(_chain(rows, k, s) for s in steps)]
            assert row[f"s{i}"] == want, (selector, pages[row.page_id])


def test_unsupported_selectors_are_named(spark):
    for bad in ["a:hover", "a + + b", "a >", "", "[x!=1]"]:
        with pytest.raises(select.SelectorError):
            select.match_ids(F.lit(None), bad)


SIBLINGS = """<main><p class="md:flex">a</p><p lang="de-AT">b</p><div><i>c</i></div><p id="1x">d</p><span><p>e</p><b>f</b><b>g</b></span></main>"""


@pytest.mark.parametrize(
    "selector, texts",
    [
        ("p:first-child", "ae"), ("p:not(:first-child)", "bd"), ("b:last-child", "g"), ("i:only-child", "c"), ("main > :nth-child(2)", "b"),
        ("main > :nth-child(odd):not(div)", ["a", "efg"]), ("main > p:nth-last-child(-n+3)", "d"), ("p + p", "b"), ("p + div i", "c"), ("div ~ p", "d"),
        ("p ~ span > b", "fg"), ("main > p:nth-child(1) + p", "b"), ("div:has(i)", "c"), ("main > :has(b)", ["efg"]), ("[lang|=de]", "b"), ("[lang|=d]", ""),
        (r".md\:flex", "a"), (r"#\31 x", "d"), ("p:is(.x, [lang])", "b"), ("b:not(.x):nth-child(2n)", "f"),
    ],
)
def test_siblings_and_pseudo_classes(spark, selector, texts):
    df = spark.createDataFrame([(1, SIBLINGS)], "page_id long, html string")
    assert [r.text for r in select.selector_match(df, selector).orderBy("pos").collect()] == list(texts)


@pytest.mark.parametrize("bad", ["p:hover", "a:nth-child(x)", "a:not(b c)", "a:not(", "> a"])
def test_unsupported_selectors(spark, bad):
    with pytest.raises(select.SelectorError):
        select.match_ids(None, bad)


def test_selectors_as_data(spark):
    """A column of plans, another one in each row, finds what the same selectors find in the plan."""
    both = [*SELECTORS, "p:first-child", "p:not(:first-child, .a)", "main > :nth-child(odd):not(div)", "main > p:nth-last-child(-n+3)", "p ~ span > b", "main > :has(b, .a)", "[lang|=de]", "[lang|='']", "[x*='']", "b:only-child, * + * i", "p:is(.x, [lang])", "div ~ div p"]
    rng = random.Random(5)
    pages = [(0, SIBLINGS)]
    for n in range(1, 6):
        html = "".join(f"<{t} {rng.choice(['class=a', 'x=1', 'lang=de-x', ''])}>" if rng.random() < 0.6 else f"</{t}>" for t in rng.choices(["div", "p", "b", "i", "ul", "li", "a", "main", "span"], k=60))
        pages.append((n, html))
    plans = select.with_plans(spark.createDataFrame([(s,) for s in both], "selector string"))
    df = spark.createDataFrame(pages, "page_id long, html string")
    each = spark.createDataFrame([(*page, s) for page in pages for s in both], "page_id long, html string, selector string")
    rows = dom.parse(each.join(plans, "selector"))
    got = {(r.page_id, r.selector): r.ids for r in rows.select("page_id", "selector", select.match_ids_by(F.col("nodes"), F.col("plan")).alias("ids")).collect()}
    want = dom.parse(df).select("page_id", *[select.match_ids(F.col("nodes"), s).alias(f"s{i}") for i, s in enumerate(both)]).collect()
    for row in want:
        for i, s in enumerate(both):
            assert got[(row.page_id, s)] == row[f"s{i}"], (s, pages[row.page_id])
    bad = {r.selector: (r.plan, r.problem) for r in select.with_plans(spark.createDataFrame([("a:hover",), ("p",), ("",)], "selector string")).collect()}
    assert bad["a:hover"][0] is None and "hover" in bad["a:hover"][1] and bad["p"][1] is None and bad[""][0] is None


@pytest.mark.parametrize("shape", ["wide", "deep"])
def test_chains_on_a_large_page(spark, shape):
    """16,000 links: every chain takes no more than twice as long as looking for the links alone, and finds the right ones."""
    n = 16_000
    html = "<nav><p>x</p>" + "<p>y</p><li><a href=x>l</a></li>" * n + "</nav>" if shape == "wide" else "<nav><p>x</p>" + "<div>" * 400 + "<li><a href=x>l</a></li>" * n + "</div>" * 400 + "</nav>"
    df = settle(dom.parse(spark.createDataFrame([(1, html)], "page_id long, html string")))

    def taken(selector):
        best = None
        for _ in range(3):
            start = time.perf_counter()
            count = df.select(F.size(select.match_ids(F.col("nodes"), selector)).alias("n")).first().n
            best = min(best or 99, time.perf_counter() - start)
        return best, count

    plain, count = taken("a")
    assert count == n
    wanted = {"li > a": n, "nav li > a": n, "p ~ li": n if shape == "wide" else 0, "li:has(a)": n, "nav li a": n, "p ~ li > a": n if shape == "wide" else 0, "li + p": n - 1 if shape == "wide" else 0}
    for selector, found in wanted.items():
        seconds, count = taken(selector)
        print(shape, selector, round(seconds, 2), "alone", round(plain, 2))
        assert count == found, selector
        assert seconds < 2 * plain + 1.5, selector


def test_browser_only_parts(spark):
    html = "<p>a</p><noscript><p>no</p></noscript><template><p>no<template></template></p></template><!--><p>b</p><!---><p>c</p><!-- x --!><p>d</p>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert [r.text for r in select.selector_match(df, "p").orderBy("pos").collect()] == ["a", "b", "c", "d"]
    assert {r.tag for r in dom.nodes(df).collect()} >= {"noscript", "template"}
