"""Column idioms shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

T = TypeVar("T")


def built(make: Callable[..., T]) -> Callable[..., T]:
    """Write down the columns that ``make`` gives once per session and arguments.

    Every call on a column goes to the JVM, and a list extraction has thousands; a
    column has no ties to a table, so it can be used again. Arguments are plain values.
    """
    held: dict[tuple, T] = {}

    @wraps(make)
    def given(*args: object) -> T:
        context = SparkContext._active_spark_context
        key = (id(context), getattr(context, "applicationId", None), *args)
        if key not in held:
            held[key] = make(*args)
        return held[key]

    return given


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A column used several times inside a lambda would be evaluated at every
    use, because an expression tree has no variables. A one-element
    ``transform`` gives it one.
    """
    return F.transform(F.array(value), body)[0]


def checked_limit(value: int | None, name: str) -> int | None:
    """A limit as it was given: None is none; what is no count is refused, not moved into a range."""
    if value is not None and value < 1:
        raise ValueError(f"{name} must be at least 1, or None for no limit")
    return value


def first_of(items: Column, limit: int | None) -> Column:
    return items if checked_limit(limit, "limit") is None else F.slice(items, 1, limit)


def start_of(text: Column, length: int | None) -> Column:
    return text if checked_limit(length, "length") is None else F.substring(text, 1, length)


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def extract_or_null(c: Column, pattern: str, group: int) -> Column:
    """``regexp_extract`` that is null, not ``''``, when nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def first_per_key(items: Column) -> Column:
    """Keep the first struct of each key, by the struct's own order.

    ``items`` is an array of structs whose leading field is ``key``; the next
    fields decide which struct of a key is first. Sorting brings equal keys
    together, so this is n log n inside one row and needs no shuffle.
    """
    return let(
        F.array_sort(items),
        lambda s: F.filter(
            s,
            lambda x, i: (i == 0) | (F.get(s, i - 1)["key"] != x["key"]),
        ),
    )


def unnest(df: DataFrame, keys: list[Column | str], items: Column, pos: str = "_pos") -> DataFrame:
    """One row per struct of the array ``items``, with its fields as columns.

    The array gets a projection of its own: field names of structs built inside
    a generator can get lost. The outer generator keeps the optimizer from
    adding a "not empty" filter, which would be pushed below that projection and
    build the array twice.
    """
    staged = df.select(*keys, items.alias("_items"))
    names = [c for c in staged.columns if c != "_items"]
    rows = staged.select(*names, F.posexplode_outer("_items").alias(pos, "_item")).where(F.col(pos).isNotNull())
    return rows.select(*names, *([] if pos == "_pos" else [pos]), "_item.*")


def runs_by_key(items: Column) -> Column:
    """Group an array of structs by their leading field ``key``.

    Gives an array of arrays, each holding the structs of one key in order:
    a group-by inside one row.
    """

    def cut(s: Column) -> Column:
        starts = F.filter(
            F.transform(s, lambda x, i: i), lambda i: (i == 0) | (F.get(s, i - 1)["key"] != F.get(s, i)["key"])
        )
        return let(
            starts,
            lambda at: F.transform(
                at, lambda i, j: F.slice(s, i + 1, F.coalesce(F.get(at, j + 1), F.size(s)) - i)
            ),
        )

    return let(F.array_sort(items), cut)


def select_where(
    df: DataFrame, keys: list[Column | str], columns: list[Column], keep: Callable[[Column], Column]
) -> DataFrame:
    """``df.select(*keys, *columns)`` with only the rows for which ``keep`` holds.

    ``keep`` gets the computed columns as a struct. A plain filter on computed
    columns is pushed below the projection by the optimizer, which then
    computes them twice.
    """
    return unnest(df, keys, F.filter(F.array(F.struct(*columns)), keep))
