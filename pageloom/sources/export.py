"""Sinks: flatten nested rows, line up ragged ones, write CSV or JSON."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.base import let

BOM = "\ufeff"
# Fields whose first non-empty array is the payload of a result.
PAYLOADS = ("items", "results", "rows", "data", "emails", "downloaded")
# More distinct names than this is no table any more.
_MAX_COLUMNS = 20_000


@dataclass
class Receipt:
    path: str
    format: str
    records: int
    bytes: int
    columns: list[str]


# ------------------------------------------------------------------ flattening


def plain_number(c: Column) -> Column:
    """A double with the fewest digits that give it back; plain from 1e-6 up to 1e21."""
    text = c.cast("string")
    parts = F.split(text, "E")
    power = F.get(parts, F.lit(1)).try_cast("int")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(F.get(parts, F.lit(0)), "[-.]", ""), "(?<=.)0+$", "")
    whole = F.rpad(F.substr(digits, F.lit(1), power + 1), power + 1, F.lit("0"))
    rest = F.substr(digits, power + 2)
    large = F.concat(sign, whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    mantissa = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(F.lit("")))
    scientific = F.concat(sign, mantissa, F.when(power > 0, F.lit("e+")).otherwise(F.lit("e")), power.cast("string"))
    return (
        F.when(power.isNull(), F.regexp_replace(text, r"\.0$", ""))
        .when(power.between(0, 20), large)
        .when(power.between(-6, -1), small)
        .otherwise(scientific)
    )


def _as_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return plain_number(c)
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, T.VariantType):
        return F.coalesce(F.try_variant_get(c, "$", "string"), F.to_json(c))
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        return F.to_json(c, {"ignoreNullFields": "false"})
    return c.cast("string")


def _flat_columns(c: Column, kind: T.DataType, name: str) -> list[Column]:
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _flat_columns(c.getField(f.name), f.dataType, f"{name}.{f.name}")]
    if isinstance(kind, T.ArrayType):
        text = F.array_join(
            F.transform(c, lambda e: F.coalesce(_as_text(e, kind.elementType), F.lit("null"))), "; "
        )
    else:
        text = _as_text(c, kind)
    return [F.coalesce(text, F.lit("")).alias(name)]


def flatten(df: DataFrame) -> DataFrame:
    """Text columns only: structs become ``a.b``, arrays are joined by ``"; "``, nulls empty."""
    columns: list[Column] = []
    for field in df.schema.fields:
        columns += _flat_columns(F.col(f"`{field.name}`"), field.dataType, field.name)
    return df.select(*columns)


# ------------------------------------------------------------------ unwrapping


def unwrap(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Rows of a JSON payload: ``keys``, ``row_no`` and one JSON object ``record``.

    An array gives its entries; an object the entries of its first non-empty
    payload array, else itself; anything that is no object becomes ``{"value": ...}``.
    """

    def entries(v: Column) -> Column:
        arrays = [F.try_variant_get(v, "$", "array<variant>")]
        for name in PAYLOADS:
            inner = F.try_variant_get(v, f"$.{name}", "array<variant>")
            arrays.append(F.when(F.size(inner) > 0, inner))
        return F.coalesce(*arrays, F.array(v))

    def record(v: Column) -> Column:
        text = F.coalesce(F.to_json(v), F.lit("null"))
        is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
        return F.when(is_object, text).otherwise(F.concat(F.lit('{"value":'), text, F.lit("}")))

    parsed = F.try_parse_json(F.col(payload))
    rows = F.transform(let(parsed, entries), record)
    return df.select(*keys, F.posexplode(rows).alias("row_no", "record"))


def unwrap_typed(df: DataFrame) -> DataFrame:
    """The same for typed results: explode the payload array of a wrapper row.

    Each row gives the entries of its first payload array that is not empty.
    Rows can only be of one table if all those arrays hold the same type.
    """
    arrays = [n for n in PAYLOADS if n in df.columns and isinstance(df.schema[n].dataType, T.ArrayType)]
    if not arrays:
        return df
    kinds = {df.schema[n].dataType.elementType.simpleString() for n in arrays}
    if len(kinds) > 1:
        raise ValueError(f"Payload arrays of different types: {', '.join(arrays)}. Select one of them.")
    kind = df.schema[arrays[0]].dataType.elementType
    entries = F.coalesce(*[F.when(F.size(f"`{n}`") > 0, F.col(f"`{n}`")) for n in arrays])
    entry = df.select(F.explode(entries).alias("value"))
    return entry.select("value.*") if isinstance(kind, T.StructType) else entry


# ------------------------------------------------------------------ ragged rows


# A quoted name, or a type in the place of a type: a name may be any of these words.
_VARIANT_TYPE = re.compile(r"`(?:[^`]|``)*`|(?:(?<=: )|(?<=<)|^)(OBJECT(?=<)|VOID(?=[,>]|$)|DECIMAL\(\d+, *\d+\)(?=[,>]|$))")


def _as_ddl(match: re.Match) -> str:
    word = match.group(1)
    if word is None:
        return match.group(0)
    return {"O": "STRUCT", "V": "STRING", "D": "DOUBLE"}[word[0]]


def first_seen_names(df: DataFrame, names: str, order: list[str]) -> list[str]:
    """Distinct names over all rows, in the order they first appear."""
    seen = df.select(*order, F.posexplode(names).alias("_pos", "_name"))
    firsts = seen.groupBy("_name").agg(F.min(F.struct(*order, "_pos")).alias("_first"))
    found = firsts.orderBy("_first").limit(_MAX_COLUMNS + 1).select("_name").collect()
    if len(found) > _MAX_COLUMNS:
        raise ValueError(f"More than {_MAX_COLUMNS} distinct columns: this is not a table.")
    return [r["_name"] for r in found]


def widen(df: DataFrame, names: str, values: str, order: list[str]) -> DataFrame:
    """Rows of ``names`` and a ``values`` map as a table; missing cells are empty."""
    columns = first_seen_names(df, names, order)
    cells = [F.coalesce(F.try_element_at(F.col(values), F.lit(n)), F.lit("")).alias(n) for n in columns]
    return df.select(*order, *cells)


def records_table(df: DataFrame, record: str, order: list[str]) -> DataFrame:
    """JSON objects of differing shapes as one flat table, columns as first seen.

    The common schema is one aggregate over all rows; nested names come in its
    order.
    """
    merged = df.agg(F.schema_of_variant_agg(F.parse_json(record)).alias("schema")).first()["schema"]
    schema = T.DataType.fromDDL(_VARIANT_TYPE.sub(_as_ddl, merged))
    top = first_seen_names(df.withColumn("_names", F.json_object_keys(record)), "_names", order)
    typed = T.StructType([schema[n] for n in top])
    parsed = df.select(*order, F.from_json(record, typed).alias("_r"))
    flat = [
        column
        for field in typed.fields
        for column in _flat_columns(F.col("_r").getField(field.name), field.dataType, field.name)
    ]
    return parsed.select(*order, *flat)


# ------------------------------------------------------------------ writing


def format_of(path: str, fallback: str = "json") -> str:
    extension = os.path.splitext(path)[1].lower()
    return {".csv": "csv", ".json": "json"}.get(extension, fallback)


def _stored_bytes(spark: SparkSession, path: str) -> int:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(f.getLen() for f in system.listStatus(target) if f.getPath().getName().startswith("part-"))


def export(df: DataFrame, path: str, fmt: str | None = None, bom: bool = True, mode: str = "errorifexists") -> Receipt:
    """Write ``df`` as CSV (flattened, with header) or as JSON lines.

    The format is the given one, else that of the extension, else JSON. Every
    task writes its own part file; each CSV part starts with header and BOM.
    """
    fmt = fmt or format_of(path)
    seen = Observation("export")
    if fmt == "csv":
        flat = flatten(df)
        columns = flat.columns
        counted = flat.observe(seen, F.count(F.lit(1)).alias("records"))
        headed = counted.toDF(*[(BOM if bom and i == 0 else "") + c for i, c in enumerate(columns)])
        (
            headed.write.mode(mode)
            .option("header", True)
            .option("escape", '"')
            .option("nullValue", "")
            .option("emptyValue", "")
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path)
        )
        if seen.get["records"] == 0:
            raise ValueError("There are no rows to write.")
    elif fmt == "json":
        columns = df.columns
        counted = df.observe(seen, F.count(F.lit(1)).alias("records"))
        counted.write.mode(mode).option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"Unknown export format: {fmt!r}")
    return Receipt(path, fmt, seen.get["records"], _stored_bytes(df.sparkSession, path), columns)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read back what :func:`export` wrote; the header row only names columns."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("nullValue", "\u0000")
        .option("emptyValue", "")
        .csv(path)
    )


def dataset(spark: SparkSession, name: str) -> DataFrame:
    """A stored table by name; an unknown name tells which ones there are."""
    if not spark.catalog.tableExists(name):
        known = ", ".join(sorted(t.name for t in spark.catalog.listTables())) or "(none)"
        raise ValueError(f'No dataset "{name}". Available: {known}')
    return spark.table(name)


def export_dataset(spark: SparkSession, source: str | DataFrame, path: str, fmt: str | None = None, bom: bool = True) -> Receipt:
    """Export a stored table or a DataFrame at hand."""
    return export(dataset(spark, source) if isinstance(source, str) else source, path, fmt, bom)


def for_csv(items: DataFrame) -> DataFrame:
    """Generic list rows under the header names of the exchange format."""
    named = {"price_value": "priceValue"}
    return items.withColumnsRenamed(named)
