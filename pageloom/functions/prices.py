"""Prices in text: find, read as a number, name the currency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.base import empty_to_null, let
from pageloom.functions.text import WS

# Currency signs and names, in matching order, and their ISO codes.
CURRENCIES = {
    "₺": "TRY",
    "TL": "TRY",
    "TRY": "TRY",
    "$": "USD",
    "USD": "USD",
    "€": "EUR",
    "EUR": "EUR",
    "£": "GBP",
    "GBP": "GBP",
    "¥": "JPY",
    "JPY": "JPY",
    "CHF": "CHF",
    "SEK": "SEK",
    "PLN": "PLN",
    "RUB": "RUB",
    "₽": "RUB",
    "₹": "INR",
    "INR": "INR",
}
# The shorter list that scoring of repeated elements looks for.
SCORED_CURRENCIES = ("₺", "TL", "TRY", "$", "USD", "€", "EUR", "£", "GBP")


def _any_of(tokens) -> str:
    return "|".join(t.replace("$", r"\$") for t in tokens)


_TOKEN = _any_of(CURRENCIES)
_SCORED = _any_of(SCORED_CURRENCIES)

PRICE = rf"(?i)(?:{_TOKEN})[{WS}]?\d[\d.,{WS}]*\d|\d[\d.,]*+[{WS}]?(?:{_TOKEN})"
SCORED_PRICE = rf"(?i)(?:{_SCORED})[{WS}]?\d|\d[\d.,]*+[{WS}]?(?:{_SCORED})"


def price_text(c: Column) -> Column:
    """First price in the text, else null."""
    return empty_to_null(F.regexp_extract(c, PRICE, 0))


def price_value(c: Column) -> Column:
    """Number of the first figure in the text, Continental or English style.

    With both separators the later one is decimal. A single kind followed by
    exactly three digits groups thousands, otherwise it is decimal.
    """
    figure = F.regexp_replace(F.regexp_extract(c, rf"\d[\d.,{WS}]*\d|\d", 0), rf"[{WS}]+", "")

    def parse(d: Column) -> Column:
        has_comma, has_dot = F.instr(d, ",") > 0, F.instr(d, ".") > 0
        after_comma = F.instr(F.reverse(d), ",") - 1
        after_dot = F.instr(F.reverse(d), ".") - 1
        no_commas = F.replace(d, F.lit(","), F.lit(""))
        no_dots = F.replace(d, F.lit("."), F.lit(""))

        def decimal_comma(x: Column) -> Column:
            return F.regexp_replace(x, r"^([^,]*),", "$1.")

        plain = (
            F.when(
                has_comma & has_dot,
                F.when(after_comma < after_dot, decimal_comma(no_dots)).otherwise(no_commas),
            )
            .when(has_comma, F.when(after_comma == 3, no_commas).otherwise(decimal_comma(d)))
            .when(has_dot & (after_dot == 3), no_dots)
            .otherwise(d)
        )
        return F.regexp_extract(plain, r"^(\d+(?:\.\d*)?)", 1).try_cast("double")

    return let(figure, parse)


def currency(c: Column) -> Column:
    """ISO code of the leftmost currency sign or name, else null."""
    codes = F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair])
    token = F.upper(F.regexp_extract(c, rf"(?i)(?:{_TOKEN})", 0))
    return F.try_element_at(codes, token)
