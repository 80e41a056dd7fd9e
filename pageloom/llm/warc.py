"""WARC archives with revisits.

Only headers are grouped by payload digest: the smallest id of a digest becomes
the response, the others refer to it. Records are put together by Spark and
written by its text writer with the record's own terminator as line separator,
so the files are WARC as they are. They are read back by record length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SALTS = 8  # tasks among which the records of one digest are dealt
PER_FILE = 5_000  # records in a file at most; a file is read as one row
# The two base-32 alphabets.
_HEX32, _RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n\r\n"


def digest32(payload: Column) -> Column:
    """Upper-case base-32 SHA-1: five hexadecimal digits are four of base 32."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _RFC32)


def resolve(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, refers_uri.

    A null payload is empty. Payloads below ``least`` bytes are always responses.
    Of equal payloads the smallest id is the response; rows that repeat that id
    are responses too, and a null id is larger than any other. The digest of a
    third of all pages is met in many tasks: rows are dealt by digest and salt,
    and of the originals, which are combined before the shuffle, there is a row per salt.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", digest32(F.col("payload")))
    heads = rows.where(F.col("payload_bytes") >= least)
    first = heads.groupBy("payload_digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("page_id").alias("refers_to"), F.min_by("url", F.struct("page_id", "url")).alias("refers_uri")
    )
    first = first.where("n > 1 AND refers_to IS NOT NULL").drop("n")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    met = rows.join(first, ["payload_digest", "salt"], "left")
    again = F.col("refers_to").isNotNull() & (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return met.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("refers_to")).alias("refers_to"),
        F.when(again, F.col("refers_uri")).alias("refers_uri"),
    )


def _urn(*parts: Column) -> Column:
    """A record id that depends on the page alone, so a repeated task writes the same one."""
    h = F.md5(F.concat_ws("\x1f", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def records(resolved: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: the text of each WARC record, without its terminator.

    Headers are fresh. A response holds an HTTP head and the payload; a revisit
    holds the HTTP head alone and names the response it repeats.
    """
    line = "\r\n"
    is_revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    length = F.octet_length(http) + F.when(is_revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    # A line end inside a URL would end the header.
    clean = lambda c: F.regexp_replace(c, r"[\r\n]", " ")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), F.col("record_type"),
        F.lit(f"{line}WARC-Record-ID: "), _urn(page, F.col("url")),
        F.lit(f"{line}WARC-Date: {date}{line}WARC-Target-URI: "), clean(F.col("url")),
        F.lit(f"{line}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit(f"{line}X-Page-Id: "), page,
        F.lit(f"{line}X-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(
            is_revisit,
            F.concat(
                F.lit(f"{line}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{line}WARC-Refers-To: "),
                _urn(F.col("refers_to").cast("string"), F.col("refers_uri")),
                F.lit(f"{line}WARC-Refers-To-Target-URI: "), clean(F.col("refers_uri")),
                F.lit(f"{line}X-Refers-To-Page: "), F.col("refers_to").cast("string"),
            ),
        ).otherwise(F.lit("")),
        F.lit(f"{line}Content-Type: application/http; msgtype=response{line}Content-Length: "), length.cast("string"), F.lit(_END),
    )
    body = F.when(is_revisit, F.lit("")).otherwise(F.decode("payload", "utf-8"))
    return resolved.select(F.concat(head, http, body).alias("value"))


def write_archives(pages: DataFrame, folder: str, least: int = 0, per_file: int = PER_FILE) -> None:
    """Resolve and write; each task writes compressed files of at most ``per_file`` records."""
    made = records(resolve(pages, least)).write.option("lineSep", _END).option("compression", "gzip")
    made.option("maxRecordsPerFile", per_file).text(folder)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, by its stated length."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        lines = raw[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
        size = int(head["Content-Length"])
        yield head, raw[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record.

    Digest and length of a response are taken from its payload, not its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                rows = []
                for head, block in parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    number, refers = head.get("X-Page-Id", ""), head.get("X-Refers-To-Page")
                    size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append((int(number) if number else None, head.get("WARC-Target-URI", ""), size, digest, head["WARC-Type"], int(refers) if refers else None))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
