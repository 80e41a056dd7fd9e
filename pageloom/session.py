"""Session settings the operators were designed with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows per Arrow batch: a page can be megabytes, so batches stay short. Shuffle files
# go when the query that wrote them has ended, not when the driver happens to collect
# its garbage: an operator of many written steps would pile them up.
_DEFAULTS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.session.timeZone": "UTC",
}


# Only at session start. Capturing the call site of every column expression
# doubles the time it takes to write down a plan.
_AT_START = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def builder(name: str = "pageloom") -> SparkSession.Builder:
    """Session builder with every setting the operators like."""
    made = SparkSession.builder.appName(name)
    for key, value in {**_AT_START, **_DEFAULTS}.items():
        made = made.config(key, value)
    return made


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; all can be changed on a live session."""
    for key, value in _DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    That is the one the cluster names in ``spark.checkpoint.dir``; where it is
    unset, as in tests on one machine, a folder in the session's warehouse. A
    cluster has to name one: a folder of the driver is not seen by executors.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, next to the checkpoints."""
    return f"{shared_root(spark)}/pageloom/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a table that ``settle`` or ``Scratch`` wrote."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, run: Scratch | None = None) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it back.

    Unlike a checkpointed RDD the files have a known size, so Spark can choose
    to broadcast what is small and prune what is not needed. They outlive lost
    executors. With ``run`` the table can be dropped as soon as it is done with.
    """
    folder = scratch_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    if run is not None:
        run.folders.append(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Scratch:
    """The settled tables of one run, to be dropped when its result is stored."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folders: list[str] = []

    def settle(self, df: DataFrame) -> DataFrame:
        return settle(df, self)

    def drop(self) -> None:
        for folder in self.folders:
            drop_folder(self.spark, folder)
        self.folders.clear()
