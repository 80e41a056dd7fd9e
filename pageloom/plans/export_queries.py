"""Export, run-log and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.operators import inspect, leads, lists, pages, runlog
from pageloom.plans import image_queries, page_queries, synth
from pageloom.plans.list_queries import _PARTS
from pageloom.session import scratch_folder
from pageloom.sources import export as sink
from pageloom.sources.captured import PAGES, read_pages, read_table, spread
from pageloom.streaming import incremental

DELIVERIES = 4


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with quotes, commas and line breaks, to CSV and back."""
    docs = read_table(spark, sf, "documents").select(
        "doc_id", F.struct("lang", "source").alias("about"), "n_chars", F.concat(F.lit(' "x", '), "text").alias("text")
    )
    path = scratch_folder(spark, "documents") + ".csv"
    receipt = sink.export(docs, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in receipt.columns])
    back = sink.read_csv(spark, path, schema)
    return back.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("`about.lang`").alias("lang"),
        F.col("`about.source`").alias("source"),
        F.md5(F.regexp_replace("text", "\r\n?", "\n")).alias("digest"),
    )


def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders").select(
        "o_orderkey",
        F.struct("o_orderstatus", "o_totalprice").alias("order"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("customer"),
    )
    path = scratch_folder(spark, "orders")
    sink.export(orders, path)
    back = spark.read.schema(orders.schema).json(path)
    return back.select("o_orderkey", "order.*", F.coalesce("customer", F.lit(-1)).alias("customer"))


def flatten_struct(spark: SparkSession, sf: str) -> DataFrame:
    nested = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.struct(
            F.col("o_orderstatus").alias("status"),
            F.struct(F.col("o_custkey").alias("id"), F.lit(None).cast("string").alias("note")).alias("customer"),
        ).alias("order"),
        F.split("o_orderpriority", "-").alias("priority"),
        F.array(F.struct(F.col("o_custkey").alias("c")), F.lit(None)).alias("objects"),
        F.col("o_totalprice").alias("total"),
        F.floor("o_totalprice").cast("double").alias("whole"),
    )
    return sink.flatten(nested)


def unwrap_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as payloads of every shape a result can have."""
    form = F.col("event_id") % 5
    props, kind = F.col("props"), F.col("event_type")
    payload = (
        F.when(form == 0, props)
        .when(form == 1, synth.cat("[", props, ",", F.col("user_id"), "]"))
        .when(form == 2, synth.cat('{"items":[],"rows":[', props, ",", props, '],"data":[1]}'))
        .when(form == 3, synth.cat('{"emails":["', kind, '"],"note":"x"}'))
        .otherwise(synth.cat('"', kind, '"'))
    )
    rows = sink.unwrap(
        read_table(spark, sf, "events").select("event_id", payload.alias("payload")), "payload", ["event_id"]
    )
    return rows


def ragged_union(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose rows have different columns, lined up in first-seen order."""
    form = F.col("c_custkey") % 3
    names = (
        F.when(form == 0, F.array(F.lit("name"), F.lit("segment")))
        .when(form == 1, F.array(F.lit("name"), F.lit("nation")))
        .otherwise(F.array(F.lit("segment"), F.lit("note")))
    )
    every = F.create_map(
        F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"),
        F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("note"), F.lit("no name"),
    )
    ragged = read_table(spark, sf, "customer").select(
        "c_custkey", names.alias("names"), F.map_filter(every, lambda k, v: F.array_contains(names, k)).alias("values")
    )
    wide = sink.widen(ragged, "names", "values", ["c_custkey"])
    order = F.lit(",".join(wide.columns))
    return wide.withColumn("header", order)


def job_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Result counts of every kind of run."""
    shops = synth.shop_pages(spark, sf, synth.part_card())
    items = lists.extract_items(shops, ".product-card").withColumn("target_id", F.col("page_id"))
    found = leads.page_leads(synth.supplier_sites(spark, sf)).withColumn(
        "target_id", F.floor(F.col("page_id") / 4).cast("long")
    ).dropDuplicates(["target_id", "kind", "value"])
    judged = image_queries.judged_documents(spark, sf)
    summary = pages.page_summary(read_pages(spark, sf), include_links=False)
    counts = [
        runlog.list_counts(items),
        runlog.lead_counts(found),
        runlog.image_counts(judged),
        runlog.text_counts(summary),
        runlog.inspect_counts(inspect.suggest_selectors(shops)),
    ]
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    return every.select("type", "target_id", F.explode("counts").alias("name", "n"))


def recent_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as runs; the fifty newest."""
    kind = F.get(F.array(*[F.lit(t) for t in runlog.TYPES]), (F.col("user_id") % 5).cast("int"))
    log = runlog.runs(
        read_table(spark, sf, "events").select(
            F.lpad(F.col("event_id").cast("string"), 12, "0").alias("run_id"),
            kind.alias("type"),
            synth.cat("https://e.test/", F.col("user_id")).alias("url"),
            F.when(F.col("event_type") == "error", "error").otherwise("done").alias("status"),
            F.col("ts").alias("started_at"),
            (F.col("ts") + F.expr("make_dt_interval(0, 0, 0, CAST(value AS DECIMAL(18, 6)))")).alias("finished_at"),
            F.lit(None).cast("string").alias("error"),
            F.create_map(F.lit("k"), F.get_json_object("props", "$.k").cast("long")).alias("counts"),
        )
    )
    return runlog.recent(log).select("run_id", "type", "status", "duration_ms", F.col("counts")["k"].alias("k"))


def _landed(df: DataFrame, source: DataFrame) -> DataFrame:
    """Pages as a stream of four deliveries, as if they had come in one after the other.

    A delivery has as many files as ``source``, the table they are made from, has
    splits, so that writing and reading it keeps all cores busy at any size.
    """
    files = source.rdd.getNumPartitions()
    folder = scratch_folder(df.sparkSession, "landed")
    df.select(*[f.name for f in PAGES.fields]).repartition(DELIVERIES * files, "page_id").write.parquet(folder)
    return incremental.page_stream(df.sparkSession, folder, files)


def stream_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The page summary, delivery by delivery."""
    captured = read_table(spark, sf, "pages")
    stream = _landed(captured, captured)
    out = scratch_folder(spark, "summary")

    def summary(df: DataFrame) -> DataFrame:
        return pages.page_summary(df).select(
            "page_id", "url", "title", "text_length", F.size("headings").alias("heading_count"),
            F.size("links").alias("link_count"),
        )

    incremental.extract_stream(stream, summary, out, scratch_folder(spark, "state")).awaitTermination()
    return spark.read.parquet(out)


def stream_links(spark: SparkSession, sf: str) -> DataFrame:
    """Link URLs that are new over all batches."""
    captured = read_table(spark, sf, "pages")
    stream = _landed(captured, captured)
    out = scratch_folder(spark, "links")
    incremental.extract_stream(
        stream, incremental.distinct_links, out, scratch_folder(spark, "state")
    ).awaitTermination()
    return spark.read.parquet(out)


def stream_items(spark: SparkSession, sf: str) -> DataFrame:
    """Brand cards that are new over all batches."""
    shops = synth.shop_pages(spark, sf, synth.brand_card())
    stream = _landed(shops, read_table(spark, sf, "part"))
    out = scratch_folder(spark, "items")
    incremental.extract_stream(
        stream, lambda s: incremental.distinct_items(s, ".product-card"), out, scratch_folder(spark, "state")
    ).awaitTermination()
    return spark.read.parquet(out).select("title", "link")


QUERIES = {
    f.__name__: f
    for f in (
        csv_roundtrip,
        json_roundtrip,
        flatten_struct,
        unwrap_rows,
        ragged_union,
        job_counts,
        recent_runs,
        stream_summary,
        stream_links,
        stream_items,
    )
}

# Text content does not separate blocks, so one address also shows up with the
# next paragraph's first word attached.
_LEADS = """
    SELECT s_suppkey AS k, 4 AS emails, 2 + CASE WHEN s_suppkey > 0 THEN 1 ELSE 0 END AS phones FROM supplier"""

ORACLE = {
    "csv_roundtrip": """
        SELECT doc_id, lang, source, md5(' "x", ' || regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS digest FROM documents""",
    "json_roundtrip": """
        SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE -1 END AS customer FROM orders""",
    "flatten_struct": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS "order.status", CAST(o_custkey AS VARCHAR) AS "order.customer.id",
               '' AS "order.customer.note", replace(o_orderpriority, '-', '; ') AS priority,
               '{"c":' || o_custkey || '}; null' AS objects,
               regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') AS total,
               CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS whole
        FROM orders""",
    "unwrap_rows": """
        WITH e AS (SELECT *, event_id % 5 AS form, replace(props, ' ', '') AS p FROM events)
        SELECT event_id, CAST(0 AS INTEGER) AS row_no, p AS record FROM e WHERE form IN (0, 1, 2)
        UNION ALL SELECT event_id, 1, '{"value":' || user_id || '}' FROM e WHERE form = 1
        UNION ALL SELECT event_id, 1, p FROM e WHERE form = 2
        UNION ALL SELECT event_id, 0, '{"value":"' || event_type || '"}' FROM e WHERE form IN (3, 4)""",
    "ragged_union": """
        SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_name ELSE '' END AS name,
               CASE WHEN c_custkey % 3 <> 1 THEN c_mktsegment ELSE '' END AS segment,
               CASE WHEN c_custkey % 3 = 1 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS nation,
               CASE WHEN c_custkey % 3 = 2 THEN 'no name' ELSE '' END AS note,
               'c_custkey,name,segment,nation,note' AS header
        FROM customer""",
    "job_counts": f"""
        SELECT 'list' AS type, page_id AS target_id, 'items' AS name, count(*) AS n FROM {_PARTS} GROUP BY page_id
        UNION ALL SELECT 'leads', k, unnest(['emails', 'phones', 'socialProfiles']), unnest([emails, phones, 1]) FROM ({_LEADS})
        UNION ALL SELECT 'images', page_id, 'found', count(*) FROM ({image_queries._JUDGED}) GROUP BY page_id
        UNION ALL SELECT 'images', page_id, 'downloaded', CAST(count_if(verdict IS NULL) AS BIGINT) FROM ({image_queries._JUDGED}) GROUP BY page_id
        UNION ALL SELECT 'text', page_id, 'textLength', text_length FROM ({page_queries.ORACLE['page_lengths']})
        UNION ALL SELECT 'inspect', page_id, 'suggestions', 2 FROM {_PARTS} GROUP BY page_id""",
    "recent_runs": """
        SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS run_id,
               CASE user_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'leads' WHEN 2 THEN 'list' WHEN 3 THEN 'images' ELSE 'inspect' END AS type,
               CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status,
               CAST(round(value * 1000) AS BIGINT) AS duration_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
        FROM events ORDER BY ts DESC, event_id DESC LIMIT 50""",
    "stream_summary": page_queries.ORACLE["page_summary"],
    "stream_links": f"SELECT DISTINCT url FROM ({page_queries.ORACLE['page_links']})",
    "stream_items": """
        SELECT DISTINCT p_brand AS title, 'https://shop.test/brand/' || replace(p_brand, '#', '-') AS link FROM part""",
}
