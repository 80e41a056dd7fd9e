"""Main text of pages by boosted trees over the nodes of their trees.

Every element, and every run of text beside block elements, gets features: its
tag, the words in its attributes and its ancestors', depth, how dense text and
links are below it, and how it compares with its siblings. The trees say how
likely a node is to hold article text. Decoding picks the likeliest labelling in
which nothing below a dropped node is kept.

There are no labelled pages, so training makes them: paragraphs and links of a
bounded sample of the given pages are set anew into many page layouts, where it
is known what is article and what is not.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.trees import Boosted, boost

SAMPLE = 200  # pages that training takes paragraphs from, at every size of the crawl

# Elements of HTML that are void, hold no markup, show no text, or stand in a line.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math select".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr #text".split())
_CLOSES_P = frozenset("address article aside blockquote details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
# Words in attributes that hint at what a part of a page is for.
_AGAINST = frozenset(
    "ad ads advert advertisement adverts aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer footer form "
    "header login masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted reader related reply responses share "
    "sharing sidebar signup site skip social sponsor sponsored subscribe tags toolbar topbar widget discussion alert feedback search".split()
)
_FOR = frozenset("article body content copy entry main post prose story text".split())
_MARKUP = re.compile(r"<!--(?:>|->|.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|aria-label|itemprop|style|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Nodes in page order: tag, attributes, parent, depth, and the text that stands directly in each."""

    def __init__(self, html: str) -> None:
        self.tag: list[str] = ["#root"]
        self.attrs: list[str] = [""]
        self.parent: list[int] = [-1]
        self.depth: list[int] = [0]
        self.flow: list[tuple[int, str]] = []  # (node, text) in page order; text None is a break
        self._parse(html)

    def _node(self, tag: str, attrs: str, parent: int) -> int:
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.tag) - 1

    def _parse(self, html: str) -> None:
        tag, parent, flow = self.tag, self.parent, self.flow
        open_, at, size = [0], 0, len(html)
        while at < size:
            m = _MARKUP.search(html, at)
            if m is None:
                flow.append((open_[-1], html[at:]))
                break
            if m.start() > at:
                flow.append((open_[-1], html[at : m.start()]))
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if name == "p" and "p" not in (tag[i] for i in open_):
                    flow.append((open_[-1], ""))
                for k in range(len(open_) - 1, 0, -1):
                    if tag[open_[k]] == name:
                        del open_[k:]
                        break
                    if name in _INLINE and tag[open_[k]] not in _INLINE:
                        break  # an inline end tag does not close a block
                if name not in _INLINE:
                    flow.append((open_[-1], ""))
                continue
            if name in ("html", "body") and name in (tag[i] for i in open_):
                continue
            if name in _CLOSES_P:
                for k in range(len(open_) - 1, 0, -1):
                    if tag[open_[k]] == "p":
                        del open_[k:]
                        break
                    if tag[open_[k]] not in _INLINE:
                        break
            elif name in _SAME:
                ends, fence = _SAME[name]
                for k in range(len(open_) - 1, 0, -1):
                    if tag[open_[k]] in ends:
                        del open_[k:]
                        if name != "tr" or tag[open_[-1]] not in ends:
                            break
                    elif tag[open_[k]] in fence:
                        break
            if name not in _INLINE:
                flow.append((open_[-1], ""))
            if name in _VOID:
                continue
            if name in _RAW:
                if not m[3].endswith("/"):
                    close = re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(html, at)
                    if close is None:
                        at = size if name not in ("svg", "math", "select") else at
                    else:
                        end = html.find(">", close.start())
                        at = size if end < 0 else end + 1
                continue
            open_.append(self._node(name, m[3], open_[-1]))
        self._wrap_runs()

    def _wrap_runs(self) -> None:
        """Text directly in a block that also holds blocks becomes a node of its own."""
        mixed = {self.parent[i] for i in range(1, len(self.tag)) if self.tag[i] not in _INLINE}
        run, out = {}, []
        last = None
        for node, text in self.flow:
            if text and node in mixed and self.tag[node] not in _INLINE:
                if last != node or node not in run:
                    run[node] = self._node("#text", "", node)
                out.append((run[node], text))
                last = node
            else:
                out.append((node, text))
                last = None if text == "" else last
        self.flow = out


_TAGS = ("p", "h1", "h2", "li", "a", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "ul", "body", "#text", "b", "blockquote", "pre")
_TAG = {t: i for i, t in enumerate(_TAGS)}
_MARKS = {"article": (0, 1), "main": (0, 1), "nav": (1, 0), "header": (1, 0), "footer": (1, 0), "aside": (1, 0), "form": (1, 0), "button": (1, 0), "dialog": (1, 0)}
WIDTH = len(_TAGS) + 19


def _words_of(attrs: str, known: dict[str, tuple[int, int, int]]) -> tuple[int, int, int]:
    """Attribute tokens against and for, and whether the element is hidden."""
    got = known.get(attrs)
    if got is None:
        against = fore = hidden = 0
        for m in _ATTRIBUTE.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                hidden = 1
            elif name not in ("style", "aria-hidden"):
                for token in _TOKEN.findall(value):
                    token = token.lower()
                    against += token in _AGAINST
                    fore += token in _FOR
        got = (against, fore, hidden)
        if len(known) < 50_000:
            known[attrs] = got
    return got


_KNOWN: dict[str, tuple[int, int, int]] = {}


def features(page: Page) -> np.ndarray:
    """One row per node."""
    tag, parent, depth = page.tag, page.parent, page.depth
    n = len(tag)
    own, links, stops, parts = [0] * n, [0] * n, [0] * n, [0] * n
    inside = [0] * n
    against, fore, hidden = [0] * n, [0] * n, [0] * n
    up_against, up_fore, up_hidden = [0] * n, [0] * n, [0] * n
    order = list(range(n))
    for i in order[1:]:
        p = parent[i]
        inside[i] = 1 if tag[i] == "a" or inside[p] else 0
        a, f, h = _words_of(page.attrs[i], _KNOWN) if page.attrs[i] else (0, 0, 0)
        mark = _MARKS.get(tag[i], (0, 0))
        against[i], fore[i], hidden[i] = a + mark[0], f + mark[1], h
        up_against[i], up_fore[i], up_hidden[i] = up_against[p] + (against[p] > 0), up_fore[p] + (fore[p] > 0), up_hidden[p] + hidden[p]
    for i, text in page.flow:
        if text:
            k = len(text.strip())
            own[i] += k
            if inside[i]:
                links[i] += k
            stops[i] += text.count(".") + text.count(",")
    total, linked, points, nodes, paras = own[:], links[:], stops[:], [1] * n, [int(t in ("p", "#text", "blockquote", "pre")) for t in tag]
    kids, index = [0] * n, [0] * n
    for i in order[1:]:
        index[i] = kids[parent[i]]
        kids[parent[i]] += 1
    # Text runs come last but have earlier parents: children always follow parents.
    for i in reversed(order[1:]):
        p = parent[i]
        total[p] += total[i]
        linked[p] += linked[i]
        points[p] += points[i]
        nodes[p] += nodes[i]
        paras[p] += paras[i]
    whole = max(total[0], 1)
    rows = np.zeros((n, WIDTH), np.float32)
    base = len(_TAGS)
    for i in order:
        k = _TAG.get(tag[i])
        if k is not None:
            rows[i, k] = 1
        p = max(parent[i], 0)
        t = total[i]
        rows[i, base:] = (
            depth[i], math.log1p(t), linked[i] / t if t else 0.0, t / nodes[i], points[i] / t if t else 0.0, paras[i], t / whole,
            t / total[p] if total[p] else 0.0, kids[p], index[i], total[p] / max(kids[p], 1), linked[p] / total[p] if total[p] else 0.0,
            against[i], fore[i], up_against[i], up_fore[i], hidden[i] + up_hidden[i], math.log1p(own[i]), kids[i],
        )
    return rows


def decode(page: Page, p: np.ndarray) -> list[bool]:
    """The likeliest labels with nothing kept below a dropped node, bottom up and then top down."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    keep, drop = np.log(p).tolist(), np.log1p(-p).tolist()
    parent, n = page.parent, len(page.parent)
    for i in range(n - 1, 0, -1):
        keep[parent[i]] += max(keep[i], drop[i])
        drop[parent[i]] += drop[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[parent[i]] and keep[i] >= drop[i]
    return kept


def text_of(page: Page, kept: list[bool]) -> str:
    """Text of kept nodes: white space within a block is one space, blocks are joined by one."""
    parts = [(text if text and kept[i] else " ") for i, text in page.flow if not text or kept[i]]
    return " ".join(unescape("".join(parts)).split())


def _layout(rng: random.Random, paras: list[str], links: list[str], short: str) -> str:
    """A page whose article is inside elements that carry data-keep, all else beside them."""
    pick, out = rng.choice, []

    def name(*choices: str) -> str:
        value = pick(choices)
        return pick((f' class="{value}"', f' id="{value}"', f' class="{value} wide"'))

    def menu(n: int) -> str:
        chosen = [pick(links) for _ in range(n)]
        if rng.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{k}">{x}</a></li>' for k, x in enumerate(chosen)) + "</ul>"
        return " | ".join(f'<a href="/{k}">{x}</a>' for k, x in enumerate(chosen))

    def sentences(low: int, high: int) -> str:
        return "".join(f"<p>{pick(paras)}</p>" for _ in range(rng.randint(low, high)))

    def aside() -> str:
        kind = rng.randrange(8)
        if kind == 0:
            return pick(("<aside>", f"<aside{name('sidebar', 'related')}>")) + sentences(0, 1) + menu(rng.randint(2, 5)) + "</aside>"
        if kind == 1:
            return f"<div{name('sidebar', 'side-bar', 'widget', 'related-posts', 'sidebar-right')}>" + menu(rng.randint(2, 6)) + sentences(0, 2) + "</div>"
        if kind == 2:
            return f"<div{name('ad', 'ads', 'advert', 'advertisement', 'ad-banner', 'sponsored', 'promo')}>" + pick((short, pick(paras), f"<p>{pick(paras)}</p>")) + "</div>"
        if kind == 3:
            return f"<div{name('cookie-notice', 'notice', 'cookie-banner', 'alert', 'consent', 'site-notice')}>" + pick((short, f"<p>{pick(paras)}</p>")) + "</div>"
        if kind == 4:
            return f"<form{pick(('', name('newsletter', 'search', 'login')))}><label>{pick(links)}</label><input name=q>" + pick(("", f"<p>{short}</p>")) + "<button>Go</button></form>"
        if kind == 5:
            tag = pick(("section", "div", "ol"))
            inner = "".join(f"<{pick(('div', 'li', 'article'))}{name('comment', 'reply')}><p>{pick(paras)}</p></div>" for _ in range(rng.randint(1, 4)))
            return f"<{tag}{name('comments', 'reader-comments', 'discussion', 'responses')}>" + pick(("", "<h3>Comments</h3>", "<h2>Discussion</h2>")) + inner + f"</{tag}>"
        if kind == 6:
            return f"<div{name('share', 'social', 'breadcrumb', 'tags', 'pagination')}>" + menu(rng.randint(1, 4)) + "</div>"
        return f'<div style="display:none">{pick(paras)}</div>'

    body = [f"<h1 data-keep>{pick(paras)[:70]}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.choice((0, 1, 2, 4, 8, 14))):
        text = pick(paras)
        if rng.random() < 0.2:
            text += f' <a href="/x">{pick(links)}</a> {pick(paras)}'
        body.append(
            pick(
                (f"<p data-keep>{text}</p>", f"<p data-keep>{text}</p>", f"<p data-keep>{text}", f"<p data-keep><b>{text}<br>", f"<h2 data-keep>{text[:50]}</h2>", f"<blockquote data-keep><p data-keep>{text}</p></blockquote>", f"<ul data-keep><li data-keep>{text}</li><li data-keep>{pick(paras)}</li></ul>", f"<div data-keep>{text}</div>", f"<table data-keep><tr data-keep><td data-keep>{text}</td><td data-keep>{pick(links)}</td></tr></table>")
            )
        )
        if rng.random() < 0.08:
            body.append(aside())
    out.append(pick((f"<nav>{menu(rng.randint(3, 7))}</nav>", f"<header><a href='/'>{pick(links)}</a>{menu(3)}</header>", f"<div{name('menu', 'nav', 'navbar', 'navigation', 'main-menu')}>{menu(rng.randint(3, 8))}</div>", f"<header{name('site-header', 'header', 'masthead')}><h1>{pick(links)}</h1><p>{short}</p></header><nav>{menu(4)}</nav>", f"<div{name('header', 'topbar')}>{short} {menu(3)}</div>", "")))
    out += [aside() for _ in range(rng.randint(0, 2))]
    wrap = pick((("<article data-keep>", "</article>"), ("<article data-keep>", "</article>"), ("<main data-keep>", "</main>"), ("<main data-keep><article data-keep>", "</article></main>"), (f"<div data-keep{name('content', 'article-body', 'post', 'entry-content', 'main-text', 'story', 'page-text')}>", "</div>"), ("<div data-keep>", "</div>"), (f"<section data-keep{name('article', 'content', 'story')}>", "</section>"), ("<div data-keep><div data-keep class=row>", "</div></div>")))
    out.append(wrap[0] + "".join(body) + wrap[1])
    out += [aside() for _ in range(rng.randint(0, 3))]
    out.append(pick((f"<footer>&copy; {short}</footer>", f"<footer><p>{pick(paras)}</p>{menu(3)}</footer>", f"<div{name('footer', 'site-footer', 'copyright')}>&copy; {short} {menu(2)}</div>", "")))
    return "<html><head><title>x</title></head><body data-keep>" + "".join(out) + "</body></html>"


def _training(pages: list[str], layouts: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of pages laid out anew. A node is positive if it holds article text."""
    rows, labels = [], []
    rng = random.Random(7)
    for html in pages:
        texts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.findall(r"<p\b[^>]*>(.*?)(?=</?p\b|</article|</body|\Z)", html or "", re.S | re.I)]
        paras = [t.replace("&", "&amp;").replace("<", "&lt;") for t in texts if t][:40] or ["Nothing here."]
        links = [" ".join(x.split()) for x in re.findall(r"<a\b[^>]*>([^<]+)</a>", html or "", re.I)][:20] or ["Home"]
        for _ in range(layouts):
            page = Page(_layout(rng, paras, links, min(paras, key=len)[:60]))
            # Attributes are seen without the mark that tells the answer.
            marked = ["data-keep" in a for a in page.attrs]
            page.attrs = [a.replace("data-keep", "") for a in page.attrs]
            n = len(page.tag)
            keep = marked[:]
            for i in range(1, n):
                keep[i] = marked[i] or ((page.tag[i] in _INLINE) and keep[page.parent[i]] and page.tag[page.parent[i]] != "body")
            keep[0] = True
            for i in range(n):
                if page.tag[i] in ("html", "head"):
                    keep[i] = True
            rows.append(features(page))
            labels.append(np.array(keep, float))
    if not rows:
        return np.zeros((0, WIDTH)), np.zeros(0)
    return np.concatenate(rows).astype(float), np.concatenate(labels)


def train(pages: DataFrame, sample: int = SAMPLE) -> Boosted:
    """Fit on layouts made from at most ``sample`` pages, picked by a hash of their markup."""
    picked = pages.select(F.col("html").cast("string").alias("html")).where("html IS NOT NULL")
    # A top-k of hashes, so that tasks send numbers; then the markup of those pages alone,
    # cut at a size that no layout needs.
    hashed = picked.select(F.xxhash64("html").alias("h"), F.substring("html", 1, 100_000).alias("html"))
    chosen = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]
    top = hashed.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("html").alias("html")) if chosen else None
    rows, labels = _training([r["html"] for r in sorted(top.collect(), key=lambda r: r["h"])] if chosen else [""])
    return boost(rows, labels, trees=40, depth=4, rate=0.3, least=8)


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``. A narrow map over whole pages.

    Null or empty html gives an empty text; so does a page without an article.
    Repeated and null ids are kept; other columns are not read.
    """
    model = model or train(pages)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [Page(html) if html else None for html in batch.column(2).to_pylist()]
            rows = [features(p) for p in parsed if p is not None]
            score = shared.value.score(np.concatenate(rows)) if rows else np.zeros(0)
            texts, at = [], 0
            for p in parsed:
                if p is None:
                    texts.append("")
                    continue
                n = len(p.tag)
                texts.append(text_of(p, decode(p, score[at : at + n])))
                at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
