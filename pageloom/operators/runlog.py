"""What runs did: result counts per target, and the log of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The kinds of run and the states they go through.
TYPES = ("text", "leads", "list", "images", "inspect")
STATUSES = ("queued", "running", "done", "error")

RUN_LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("error", T.StringType()),
        T.StructField("counts", T.MapType(T.StringType(), T.LongType())),
    ]
)


def _counted(df: DataFrame, key: str, kind: str, counts: dict[str, Column]) -> DataFrame:
    """``type, target_id, counts`` with one named count per aggregate."""
    grouped = df.groupBy(F.col(key).alias("target_id")).agg(
        *[F.coalesce(agg, F.lit(0)).cast("long").alias(name) for name, agg in counts.items()]
    )
    pairs = [x for name in counts for x in (F.lit(name), F.col(name))]
    return grouped.select(F.lit(kind).alias("type"), "target_id", F.create_map(*pairs).alias("counts"))


def list_counts(items: DataFrame) -> DataFrame:
    return _counted(items, "target_id", "list", {"items": F.count("*")})


def lead_counts(leads: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return _counted(
        leads,
        "target_id",
        "leads",
        {
            "emails": F.count_if(kind == "email"),
            "phones": F.count_if(kind == "phone"),
            "socialProfiles": F.count_if(kind == "social"),
        },
    )


def image_counts(judged: DataFrame) -> DataFrame:
    return _counted(
        judged, "page_id", "images", {"downloaded": F.count_if(F.col("reason").isNull()), "found": F.count("*")}
    )


def text_counts(summary: DataFrame) -> DataFrame:
    return _counted(summary, "page_id", "text", {"textLength": F.max("text_length")})


def inspect_counts(suggestions: DataFrame) -> DataFrame:
    return _counted(suggestions, "page_id", "inspect", {"suggestions": F.count("*")})


def runs(results: DataFrame) -> DataFrame:
    """Complete rows for the log; ``duration_ms`` follows from the times."""
    given = results.withColumn("duration_ms", F.lit(None).cast("long")).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in RUN_LOG.fields]
    )
    took = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000
    known = F.col("type").isin(*TYPES) & F.col("status").isin(*STATUSES)
    return given.withColumn("duration_ms", F.floor(took).cast("long")).where(known)


def append_runs(results: DataFrame, folder: str) -> None:
    """Write complete rows to the log, a Parquet folder by type of run."""
    runs(results).write.mode("append").partitionBy("type").parquet(folder)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RUN_LOG).parquet(folder).select(*RUN_LOG.names)


def datasets(run_log: DataFrame) -> DataFrame:
    """What runs have left to export: id, tool, url, time and counts of those that are done."""
    done = run_log.where("status = 'done'")
    return done.select(F.col("run_id").alias("dataset_id"), F.col("type").alias("tool"), "url", F.col("finished_at").alias("made_at"), "counts")


def recent(run_log: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs; a top-k, so no full sort of the log."""
    return run_log.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)
