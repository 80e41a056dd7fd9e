"""Structured Streaming over folders of captured pages.

The per-page operators contain no window and no shuffle, so they run on a
stream as they are. Only what looks across batches needs state or a look at
what was written before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom.functions.base import unnest
from pageloom.operators import lists, pages
from pageloom.sources.captured import CAPTURED, PAGES

Transform = Callable[[DataFrame], DataFrame]


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000, keep_for: str | None = None) -> DataFrame:
    """Pages as they land. With ``keep_for``, such as "7 days", they have a capture
    time, and what looks across batches forgets what is older than that."""
    schema = PAGES if keep_for is None else CAPTURED
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream if keep_for is None else stream.withWatermark("captured_at", keep_for)


def extract_stream(stream: DataFrame, transform: Transform, out: str, state: str) -> StreamingQuery:
    """Append ``transform`` of every new page to ``out``; exactly once by the file sink."""
    return (
        transform(stream)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def distinct_links(stream: DataFrame) -> DataFrame:
    """Link URLs never seen before, over all batches.

    With a watermarked ``captured_at`` the state is dropped once it is old
    enough; without one it holds every URL.
    """
    timed = "captured_at" in stream.columns
    keys = ["captured_at"] if timed else []
    found = unnest(stream, keys, pages.links(pages.markup(F.col("html")), pages.base_url(stream)))
    seen = found.select(*keys, "url")
    return seen.dropDuplicatesWithinWatermark(["url"]) if timed else seen.dropDuplicates(["url"])


def distinct_items(stream: DataFrame, selector: str, fields: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """List rows whose record no earlier batch had, by fingerprint.

    The state is one digest per distinct record, so a batch never looks at what
    was written before. With a watermarked ``captured_at`` it is dropped once it
    is old enough.
    """
    timed = "captured_at" in stream.columns
    keys = ["page_id", "captured_at"] if timed else ["page_id"]
    rows = lists.extract_items(stream, selector, fields, keys)
    payload = [c for c in rows.columns if c not in (*keys, "item_idx")]
    marked = rows.withColumn("fingerprint", lists.fingerprint(payload))
    if timed:
        return marked.dropDuplicatesWithinWatermark(["fingerprint"])
    return marked.dropDuplicates(["fingerprint"])
