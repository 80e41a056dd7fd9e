"""Contact details in text: e-mails, phone numbers, social profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.base import let
from pageloom.functions.text import WS, trim_ws
from pageloom.functions.urls import percent_decode

# Fixed values ---------------------------------------------------------------

_EMAIL_CHARS = "a-zA-Z0-9._%+'-"
# An address starts where its run of characters starts or where the last match
# ended. Saying so keeps long runs without "@" (inlined images) linear, and the
# bound on labels lies beyond the longest domain.
EMAIL = (
    rf"(?:\G|(?<![{_EMAIL_CHARS}]))[{_EMAIL_CHARS}]++@"
    r"[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+){0,500}\.[a-zA-Z]{2,24}"
)
PHONE = rf"(?=[+0-9])(?:\+|00)?\d{{1,4}}?[{WS}.\-]?\(?\d{{2,4}}\)?(?:[{WS}.\-]?\d{{2,4}}){{2,4}}"
_ASSET = r"\.(?:png|jpe?g|gif|webp|svg|bmp|ico|css|js)$"
JUNK_DOMAINS = (
    "example.com",
    "example.org",
    "domain.com",
    "yourdomain.com",
    "email.com",
    "sentry.io",
    "sentry-next.wixpress.com",
    "wix.com",
    "schema.org",
    "w3.org",
    "godaddy.com",
)
SOCIAL = {
    "facebook": r"^https?://(?:www\.)?(?:facebook|fb)\.com/[^/?#]+",
    "instagram": r"^https?://(?:www\.)?instagram\.com/[^/?#]+",
    "x": r"^https?://(?:www\.)?(?:twitter|x)\.com/[^/?#]+",
    "linkedin": r"^https?://(?:[a-z]{2,3}\.)?linkedin\.com/(?:company|in)/[^/?#]+",
    "youtube": r"^https?://(?:www\.)?youtube\.com/(?:@|c/|channel/|user/)[^/?#]+",
    "tiktok": r"^https?://(?:www\.)?tiktok\.com/@[^/?#]+",
    "whatsapp": rf"^https?://(?:api\.whatsapp\.com|wa\.me)/[^{WS}\"']+",
    "telegram": r"^https?://(?:t\.me|telegram\.me)/[^/?#]+",
}
CONTACT_HINTS = (
    "contact",
    "kontakt",
    "iletisim",
    "ileti[şŞ]im",
    "about",
    "hakkim",
    "hakkında",
    "impressum",
    "imprint",
    "support",
    "destek",
    "reach-us",
    "team",
    "ekibimiz",
)
ADDRESS_SELECTOR = "address, [itemprop='address'], [itemprop='streetAddress'], .address, .adres"

# ---------------------------------------------------------------- e-mails


_S = f"[{WS}]"
# Each rewrite has a cheap test that starts at a rare character; hardly any text
# passes one.
# Spellings of @ and dot that are read as such.
_REWRITES = (
    (rf"[\[({{<]{_S}*(?:at|@|[äÄ]t)", rf"{_S}*[\[({{<]{_S}*(?:at|@|[äÄ]t){_S}*[\])}}>]{_S}*", "@"),
    (
        rf"at(?<={_S}at){_S}+[a-z0-9-]+{_S}*(?:\.|\[dot\]|\(dot\))",
        rf"{_S}+at{_S}+(?=[a-z0-9-]+{_S}*(?:\.|\[dot\]|\(dot\)){_S}*[a-z]{{2,}})",
        "@",
    ),
    (
        rf"[\[({{<]{_S}*(?:dot|punkt|nokta)",
        rf"{_S}*[\[({{<]{_S}*(?:dot|punkt|nokta){_S}*[\])}}>]{_S}*",
        ".",
    ),
    (rf"(?:dot|nokta)(?={_S})", rf"{_S}+(?:dot|nokta){_S}+", "."),
)


def deobfuscate(c: Column) -> Column:
    """Undo ``info [at] site [dot] com`` and its kin."""

    def rewrite(text: Column, steps) -> Column:
        if not steps:
            return text
        test, pattern, by = steps[0]
        changed = F.when(text.rlike(f"(?i){test}"), F.regexp_replace(text, f"(?i){pattern}", by)).otherwise(text)
        return let(changed, lambda t: rewrite(t, steps[1:]))

    return let(c, lambda t: rewrite(t, _REWRITES))


def scan_emails(c: Column) -> Column:
    """Everything in the text that has the shape of an e-mail address."""
    return F.when(F.instr(c, "@") > 0, F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def clean_email(c: Column) -> Column:
    """Lower-cased address, or null for asset names, junk and placeholders."""

    def judge(e: Column) -> Column:
        domain = F.get(F.split(e, "@"), F.lit(1))
        junk = F.lit(False)
        for name in JUNK_DOMAINS:
            junk = junk | (domain == name) | domain.endswith("." + name)
        good = (
            (F.instr(e, "@") > 0)
            & (F.length(e) <= 254)
            & ~e.rlike(_ASSET)
            & ~e.rlike(r"@\d+(?:\.\d+)*x?$")
            & (F.instr(domain, ".") > 0)
            & ~junk
            & ~e.rlike(r"^[0-9a-f]{16,}@")
        )
        return F.when(good, e)

    edges = F.regexp_replace(F.regexp_replace(trim_ws(c), r"^[.'-]+", ""), r"[.'-]+\z", "")
    return let(F.lower(edges), judge)


def written_emails(found: Column) -> Column:
    """Addresses of an array as they were found, in lower case: none trimmed, none refused."""
    return F.transform(found, F.lower)


def clean_emails(found: Column) -> Column:
    """Distinct clean addresses of an array of raw ones."""
    return F.array_distinct(
        F.filter(F.transform(found, clean_email), lambda e: e.isNotNull())
    )


def mailto_addresses(href: Column) -> Column:
    """Raw addresses of a ``mailto:`` link; empty for malformed escapes."""
    value = percent_decode(F.regexp_replace(href, r"(?is)^mailto:|\?.*\z", ""))
    return F.coalesce(F.split(value, "[,;]"), F.array().cast("array<string>"))


# ---------------------------------------------------------------- phones


def scan_phones(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PHONE), F.lit(0))


def normalize_phone(c: Column) -> Column:
    """Digits of a dialable number, or null for dates, ids and placeholders."""
    ascending = "0123456789" * 2
    descending = ascending[::-1]

    def judge(t: Column) -> Column:
        digits = F.regexp_replace(t, r"\D", "")
        plus = t.startswith("+") | t.startswith("00")
        bad = (
            ~F.length(digits).between(7, 15)
            | digits.rlike(r"^(\d)\1+$")
            | ((F.length(digits) <= 8) & digits.rlike("^(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])"))
            | (F.instr(F.lit(ascending), digits) > 0)
            | (F.instr(F.lit(descending), digits) > 0)
            | (~plus & (F.length(digits) < 10) & ~t.rlike(rf"[{WS}.\-()]"))
        )
        international = F.concat(F.lit("+"), F.regexp_replace(digits, "^0+", ""))
        return F.when(~bad, F.when(plus, international).otherwise(digits))

    return let(trim_ws(c), judge)


def tel_number(href: Column) -> Column:
    """Raw number of a ``tel:`` link; null for malformed escapes."""
    return trim_ws(percent_decode(F.regexp_replace(href, "(?i)^tel:", "")))


# ---------------------------------------------------------------- links


def social_network(url: Column) -> Column:
    """Network of a profile URL, else null."""
    network = F.lit(None).cast("string")
    for name, pattern in reversed(SOCIAL.items()):
        network = F.when(url.rlike("(?i)" + pattern), F.lit(name)).otherwise(network)
    return network


def is_contact_label(label: Column) -> Column:
    """Link text or target that hints at a contact page."""
    return label.rlike(f"(?i)(?:{'|'.join(CONTACT_HINTS)})")
