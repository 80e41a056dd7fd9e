"""URL columns: normalise, resolve, take apart.

Follows the WHATWG URL rules for http(s): scheme and host in lower case, default
ports dropped, dot segments resolved, unsafe characters percent-encoded.
International host names are lower-cased but not turned into punycode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.base import let
from pageloom.functions.text import trim_ws

_PARTS = r"(?is)^(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?\z"
_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
_BAD_HOST = r"""[\x00-\x20"#%/:<>?@\[\\\]^`{|}\x7f]"""
_ESCAPED = r"""[^\x21-\x7e]|["<>`{}]"""


# Already in canonical form: no escapes to add, no port, no dot segments.
_CANONICAL = r"""^https?://[a-z0-9][a-z0-9.-]*/(?:[!$-;=?-\[\]^_a-z|~](?!(?<=/)\.))*+(?:#[!$-;=?-\[\]^_a-z|~]*+)?\z"""


def _part(u: Column, group: int) -> Column:
    return F.regexp_extract(u, _PARTS, group)


def _percent_encode(c: Column, also: str = "") -> Column:
    """Escape what may not stand in a URL, as UTF-8 bytes."""
    unsafe = _ESCAPED + (f"|[{also}]" if also else "")

    def encode(text: Column) -> Column:
        escaped = F.transform(
            F.split(text, ""),
            lambda ch: F.when(ch == " ", F.lit("%20")).when(ch.rlike(unsafe), F.url_encode(ch)).otherwise(ch),
        )
        return F.when(text.rlike(unsafe), F.array_join(escaped, "")).otherwise(text)

    return let(c, encode)


def _resolve_dots(path: Column) -> Column:
    """Apply ``.`` and ``..`` segments."""

    def apply(p: Column) -> Column:
        kept = F.aggregate(
            F.split(p, "/"),
            F.array().cast("array<string>"),
            lambda acc, seg: F.when(
                seg == "..",
                F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc),
            )
            .when(seg == ".", acc)
            .otherwise(F.concat(acc, F.array(seg))),
        )
        tail = F.when(p.rlike(r"/\.\.?\z"), F.lit("/")).otherwise(F.lit(""))
        joined = F.regexp_replace(F.concat(F.array_join(kept, "/"), tail), "^(?!/)", "/")
        return F.when(p.rlike(r"/\.\.?(?:/|\z)"), joined).otherwise(p)

    return let(path, apply)


def _authority(raw: Column, scheme: Column) -> Column:
    """Canonical ``[user@]host[:port]``; null when there is no usable host."""

    def join(a: Column) -> Column:
        host, port = a["host"], a["port"]
        usual = (port == "") | (port == F.when(scheme == "http", "80").otherwise("443"))
        good = (
            (host != "")
            & (~host.rlike(_BAD_HOST) | host.rlike(r"^\[[0-9a-f:.]+\]\z"))
            & (F.length(port) < 10)
            & (F.coalesce(port.try_cast("long"), F.lit(0)) <= 65535)
        )
        return F.when(good, F.concat(a["user"], host, F.when(usual, "").otherwise(F.concat(F.lit(":"), port))))

    rest = F.regexp_replace(raw, r"^.*@", "")
    return let(
        F.struct(
            F.regexp_extract(raw, r"^(.*@)", 1).alias("user"),
            F.lower(F.regexp_replace(rest, r":[0-9]*\z", "")).alias("host"),
            F.regexp_extract(rest, r":([0-9]*)\z", 1).alias("port"),
        ),
        join,
    )


def _canonical(u: Column) -> Column:
    """Serialise an absolute http(s) URL."""

    def serialise(x: Column) -> Column:
        path = F.translate(x["path"], "\\", "/")
        return F.concat(
            x["scheme"],
            F.lit("://"),
            _authority(x["authority"], x["scheme"]),
            F.when(path == "", F.lit("/")).otherwise(_percent_encode(_resolve_dots(path))),
            _percent_encode(x["query"], "'"),
            _percent_encode(x["fragment"]),
        )

    parts = F.struct(
        F.lower(_part(u, 1)).alias("scheme"),
        _part(u, 2).alias("authority"),
        _part(u, 3).alias("path"),
        _part(u, 4).alias("query"),
        _part(u, 5).alias("fragment"),
    )
    return F.when(u.rlike(_CANONICAL), u).when(u.rlike(_PARTS), let(parts, serialise))


def _clean(c: Column) -> Column:
    return F.translate(trim_ws(c), "\t\n\r", "")


def normalize_url(c: Column) -> Column:
    """Canonical http(s) URL; ``https://`` is added only if there is no scheme.

    Null for other schemes and for text that is no URL.
    """
    return let(
        _clean(c),
        lambda v: _canonical(
            F.when(v.rlike(_SCHEME), v).otherwise(F.concat(F.lit("https://"), v))
        ),
    )


def normalize_error(c: Column) -> Column:
    """Why :func:`normalize_url` gave null, else null. The messages are fixed values."""
    return let(
        F.struct(_clean(c).alias("v"), normalize_url(c).alias("ok")),
        lambda x: F.when(x["ok"].isNotNull(), F.lit(None).cast("string"))
        .when(
            x["v"].rlike(_SCHEME) & ~x["v"].rlike("(?i)^https?:"),
            F.concat(
                F.lit('Only http/https URLs are supported, got "'),
                F.lower(F.regexp_extract(x["v"], _SCHEME, 0)),
                F.lit('"'),
            ),
        )
        .otherwise(F.concat(F.lit('Invalid URL: "'), c, F.lit('"'))),
    )


def base_parts(url: Column) -> Column:
    """The pieces of a page URL that relative links need."""
    return let(
        normalize_url(url),
        lambda u: F.struct(
            F.lower(_part(u, 1)).alias("scheme"),
            F.concat(_part(u, 1), F.lit("://"), _part(u, 2)).alias("origin"),
            _part(u, 3).alias("path"),
            _part(u, 4).alias("query"),
            F.regexp_extract(u, r"^https?://[^?#]*/", 0).alias("folder"),
        ),
    )


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` on a page with :func:`base_parts` ``base``.

    Null for empty values, ``javascript:``, a bare ``#`` and unusable URLs.
    """

    def absolute(v: Column) -> Column:
        return (
            F.when(v.rlike(_SCHEME), v)
            .when(v.rlike(r"^[/\\]{2}"), F.concat(base["scheme"], F.lit(":"), v))
            .when(v.rlike(r"^[/\\]"), F.concat(base["origin"], v))
            .when(v.startswith("?"), F.concat(base["origin"], base["path"], v))
            .when(v.startswith("#"), F.concat(base["origin"], base["path"], base["query"], v))
            .otherwise(F.concat(base["folder"], v))
        )

    def serialise(u: Column) -> Column:
        opaque = F.concat(
            F.lower(F.regexp_extract(u, _SCHEME, 0)), F.regexp_replace(u, _SCHEME, "")
        )
        return F.coalesce(_canonical(u), F.when(~u.rlike("(?i)^https?:"), opaque))

    return let(
        _clean(href),
        lambda v: F.when(
            (v != "") & ~v.startswith("javascript:") & (v != "#"), let(absolute(v), serialise)
        ),
    )


def fetch_key(url: Column) -> Column:
    """What identifies the document behind a URL: the URL without its fragment."""
    return F.regexp_replace(normalize_url(url), r"#.*\z", "")


def url_origin(url: Column) -> Column:
    """Scheme, host and non-default port; null unless http(s)."""
    return F.nullif(
        F.regexp_replace(F.regexp_extract(normalize_url(url), r"^https?://[^/?#]*", 0), r"//.*@", "//"),
        F.lit(""),
    )


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url_origin(url), r"^https?://", ""), r":[0-9]+\z", "")


def url_path(url: Column) -> Column:
    return _part(normalize_url(url), 3)


def last_segment(url: Column) -> Column:
    """Last non-empty path segment, else null."""
    return F.nullif(F.regexp_extract(url_path(url), r"([^/]+)/*\z", 1), F.lit(""))


def percent_decode(c: Column) -> Column:
    """Percent-decoding that keeps ``+``; null for malformed escapes."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
