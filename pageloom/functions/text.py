"""Markup to text: entities, whitespace, readable text.

All of it runs in the JVM on the ``html`` column; no tree is built.
"""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.base import extract_or_null, let

# The whitespace that a browser's trim() and \s know, as the body
# of a regex character class. Java's \s has only the ASCII part.
NBSP = chr(0xA0)
_WIDE = [(0x1680,), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F,), (0x205F,), (0x3000,), (0xFEFF,)]
WS = rf"\t\n\x0B\f\r {NBSP}" + "".join("-".join(map(chr, r)) for r in _WIDE)
_SPACES = "\t\n\x0b\f\r " + NBSP + "".join(chr(c) for r in _WIDE for c in range(r[0], r[-1] + 1))

# The rest of a tag after its name. Quotes only count after "=", and every
# quantifier is possessive: linear time, and no deep recursion in the matcher.
ATTRS = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_NAME_END = r"(?=[\s/>])"

# Elements without readable content, and elements that end a line.
DROPPED = "script|style|noscript|svg|iframe|template"
LEAD_DROPPED = "script|style|noscript"
BLOCKS = "p|div|section|article|li|tr|h[1-6]"

# Start tags (or end tags) at which an open paragraph ends.
_P_ENDERS = (
    "address|article|aside|blockquote|body|caption|center|dd|details|dialog|dir|div|dl|dt|"
    "fieldset|figcaption|figure|footer|form|h[1-6]|header|hgroup|hr|html|li|main|menu|nav|"
    "ol|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul"
)


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def collapse(c: Column) -> Column:
    """Tidy whitespace but keep single and double line breaks.

    Each step runs only where a byte search finds something to tidy, which most
    text does not have.
    """

    def spaces(t: Column) -> Column:
        odd = t.contains("  ") | t.contains("\t") | t.contains(NBSP)
        return F.when(odd, F.regexp_replace(t, rf"[ \t{NBSP}]{{2,}}|[\t{NBSP}]", " ")).otherwise(t)

    def line_edges(t: Column) -> Column:
        odd = t.contains(" \n") | t.contains("\n ")
        return F.when(odd, F.regexp_replace(t, r" \n ?|\n ", "\n")).otherwise(t)

    def blank_lines(t: Column) -> Column:
        return F.when(t.contains("\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)

    plain = F.replace(c, F.lit("\r"), F.lit(""))
    return trim_ws(let(let(let(plain, spaces), line_edges), blank_lines))


def squash(c: Column) -> Column:
    """Every run of whitespace becomes one space."""
    return trim_ws(F.regexp_replace(c, rf"[{WS}]+", " "))


def truncate(c: Column, limit: int) -> Column:
    """Cut at ``limit`` characters and say how many were left out."""
    more = F.length(c) - limit
    return F.when(
        more > 0,
        F.concat(
            F.substring(c, 1, limit),
            F.lit("\n\n…[truncated "),
            more.cast("string"),
            F.lit(" more characters]"),
        ),
    ).otherwise(c)


# ------------------------------------------------------------------ entities

# Names that are also known without a semicolon.
_LEGACY = {n: c for n, c in html5.items() if not n.endswith(";")}
_REFERENCE = (
    rf"^(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*+;|(?:{'|'.join(sorted(_LEGACY, key=len, reverse=True))}))"
)
_C1 = "".join(chr(i) for i in range(128, 160))
_C1_AS_CP1252 = "".join(bytes([i]).decode("cp1252", "replace") for i in range(128, 160))


# One literal each; a call per entry would make every plan slow to build. Maps are
# searched from the front: the names of HTML 4 first, then all others, then those
# that may stand without a semicolon, whatever follows them.
_COMMON = {f"{n};" for n in [*name2codepoint, "apos"]}


def _table(names: dict[str, str]) -> Column:
    return F.str_to_map(F.lit("\x02".join(f"{n}\x01{c}" for n, c in names.items())), F.lit("\x02"), F.lit("\x01"))


def _char(code: Column) -> Column:
    """Code point to character; ``chr`` would only reach 255."""
    bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    safe = F.when(bad | code.isNull(), F.lit(0xFFFD)).otherwise(code)
    ch = F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
    return F.translate(ch, _C1, _C1_AS_CP1252)


def _decode_number(seg: Column, number: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(number, "[#xX;]", ""), "^0+", "")
    # More digits than any character has are read as far as it takes to know that.
    short = F.when(F.length(digits) > 7, F.lit("9999999")).otherwise(digits)
    value = F.when(number.rlike("^#[xX]"), F.conv(short, 16, 10)).otherwise(short).try_cast("long")
    return F.concat(let(value, _char), F.substr(seg, F.length(number) + 1))


def _decode_name(seg: Column, name: Column) -> Column:
    """``name`` may end in a semicolon, which is then used up too; else its longest start that is a legacy name counts."""
    common = _table({n: c for n, c in html5.items() if n in _COMMON})
    others = _table({n: c for n, c in html5.items() if n.endswith(";") and n not in _COMMON})
    whole = F.coalesce(F.try_element_at(common, name), F.try_element_at(others, name))

    def by_start(start: Column) -> Column:
        return F.when(start.isNull(), F.concat(F.lit("&"), seg)).otherwise(F.concat(start["c"], F.substr(seg, start["n"] + 1)))

    lengths = sorted({len(n) for n in _LEGACY}, reverse=True)
    legacy = _table(_LEGACY)

    def starts(table: Column) -> Column:
        found = F.transform(F.array(*[F.lit(k) for k in lengths]), lambda k: F.struct(F.try_element_at(table, F.when(F.length(name) >= k, F.substr(name, F.lit(1), k))).alias("c"), k.alias("n")))
        return F.get(F.filter(found, lambda x: x["c"].isNotNull()), F.lit(0))

    return let(
        F.when(name.endswith(";"), whole),
        lambda hit: F.when(hit.isNotNull(), F.concat(hit, F.substr(seg, F.length(name) + 1))).otherwise(let(starts(legacy), by_start)),
    )


def _decode_segment(seg: Column) -> Column:
    """``seg`` is what follows an ampersand."""
    return let(
        F.regexp_extract(seg, _REFERENCE, 0),
        lambda ref: F.when(ref == "", F.concat(F.lit("&"), seg))
        .when(ref == "amp;", F.concat(F.lit("&"), F.substr(seg, F.lit(5))))
        .when(ref.startswith("#"), _decode_number(seg, ref))
        .otherwise(_decode_name(seg, ref)),
    )


def unescape(c: Column) -> Column:
    """Decode character references, each once (``&amp;lt;`` gives ``&lt;``).

    Knows numeric references and all names, legacy ones also without a semicolon.
    Text without an ampersand takes the short way out.
    """

    def decode(text: Column) -> Column:
        parts = F.transform(
            F.split(text, "&"), lambda s, i: F.when(i == 0, s).otherwise(_decode_segment(s))
        )
        return F.when(F.instr(text, "&") == 0, text).otherwise(F.array_join(parts, ""))

    return let(c, decode)


# ------------------------------------------------------------------ markup

_COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\z))"
_ANY_TAG = rf"<(?:/?[a-zA-Z]{ATTRS}|[!?][^>]*+)>"


def drop_elements(html: Column, names: str) -> Column:
    """Remove comments and the named elements with all they hold."""
    return F.regexp_replace(
        html,
        rf"(?is){_COMMENT}|<({names}){_NAME_END}{ATTRS}>.*?(?:</\1{_NAME_END}[^>]*+>|\z)",
        "",
    )


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, rf"(?is){_ANY_TAG}", "")


def body_markup(html: Column) -> Column:
    """What lies in the body, also when its tag is left out."""
    before = F.regexp_extract(html, rf"(?is)^.*?<body{_NAME_END}{ATTRS}>", 0)
    head = rf"(?is)<head{_NAME_END}.*?</head\s*>|<title{_NAME_END}.*?(?:</title\s*>|\z)"
    return let(
        before,
        lambda b: F.when(b != "", F.substr(html, F.length(b) + 1)).otherwise(
            F.regexp_replace(html, head, "")
        ),
    )


def _close_open(html: Column, name: str, enders: str) -> Column:
    """Write out the end tag that a browser would imply for ``name``."""
    return F.regexp_replace(
        html,
        rf"(?is)(<({name}){_NAME_END}{ATTRS}>"
        rf"(?:[^<]++|<(?!/?(?:{enders}){_NAME_END}))*+)(?!</(?:{name}){_NAME_END})",
        "$1</$2>",
    )


def with_implied_ends(html: Column) -> Column:
    html = _close_open(html, "p", _P_ENDERS)
    html = _close_open(html, "h[1-6]", "h[1-6]|body|html|article|section")
    html = _close_open(html, "tr", "tr|table|tbody|thead|tfoot|body|html")
    return _close_open(html, "li", "li|ul|ol|menu|body|html")


# Anything but tags at the start of the markup.
_HAS_TEXT = rf"(?is)^(?:{_ANY_TAG})*+(?!<(?:[/!?]|[a-z])).+"


def readable_text(html: Column) -> Column:
    """Readable text of a page or fragment, one line per block.

    A page whose body holds nothing at all gives the text of its head.
    """

    def lines(markup: Column) -> Column:
        markup = F.regexp_replace(markup, rf"(?is)<(?:br{_NAME_END}{ATTRS}|/(?:{BLOCKS})\s*)>", "\n")
        return unescape(strip_tags(markup))

    def chosen(whole: Column) -> Column:
        something = rf"{_HAS_TEXT}|<br{_NAME_END}|</(?:{BLOCKS})\s*>"
        return let(body_markup(whole), lambda b: F.when(b.rlike(something), b).otherwise(whole))

    return collapse(lines(let(with_implied_ends(drop_elements(html, DROPPED)), chosen)))


def lead_text(html: Column) -> Column:
    """Plain text content, blocks not separated: what contact scans read."""

    def chosen(whole: Column) -> Column:
        return let(body_markup(whole), lambda b: F.when(b.rlike(_HAS_TEXT), b).otherwise(whole))

    return collapse(unescape(strip_tags(let(drop_elements(html, LEAD_DROPPED), chosen))))


def fragment_text(html: Column) -> Column:
    """Text content of inline markup such as the inside of a link."""
    return F.when(F.instr(html, "<") == 0, unescape(html)).otherwise(unescape(strip_tags(html)))


def attribute(tag: Column, name: str, decode: bool = True) -> Column:
    """Value of an attribute in the text of one start tag, else null."""
    value = r"""("[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
    other = (
        rf"""[\s/]++(?!{name}[\s=/>])[^\s=/>][^\s=/>]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+"""
    )
    pattern = rf"(?is)^<[a-z][^\s/>]*+(?:{other})*+[\s/]++{name}\s*+=\s*+{value}"
    bare = F.regexp_replace(extract_or_null(tag, pattern, 1), r"(?s)^([\"'])(.*)\1\z", "$2")
    return unescape(bare) if decode else bare


def _element(name: str) -> str:
    return (
        rf"(?is)<(?:{name}){_NAME_END}{ATTRS}>(?:[^<]++|<(?!/?(?:{name}){_NAME_END}))*+"
        rf"(?:</(?:{name}){_NAME_END})?+"
    )


def elements(markup: Column, name: str) -> Column:
    """Source of each ``name`` element, in document order.

    For elements that cannot hold themselves (links, headings, titles): each
    ends at its end tag or where the next one starts.
    """
    return F.regexp_extract_all(markup, F.lit(_element(name)), F.lit(0))


def first_element(markup: Column, name: str) -> Column:
    """Source of the first ``name`` element, else null; reads no further."""
    return F.nullif(F.regexp_extract(markup, _element(name), 0), F.lit(""))


def start_tags(markup: Column, name: str) -> Column:
    return F.regexp_extract_all(markup, F.lit(rf"(?is)<(?:{name}){_NAME_END}{ATTRS}>"), F.lit(0))


def inner(element: Column) -> Column:
    """Inside of one element from :func:`elements`."""
    return F.regexp_replace(element, rf"(?is)^<[a-z]{ATTRS}>|</[a-z0-9]+\z", "")
