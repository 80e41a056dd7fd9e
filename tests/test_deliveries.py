"""Landed pages of the streaming queries: four batches at any size, each of as many files as the input has splits."""

from pyspark.sql import functions as F

from pageloom.plans import export_queries


def test_a_batch_has_as_many_files_as_the_input_has_splits(spark, tmp_path):
    made = spark.range(400).select(F.col("id").alias("page_id"), F.lit("https://a.test/").alias("url"), F.lit("<p>x</p>").alias("html"))
    made.repartition(6).write.parquet(str(tmp_path / "pages.parquet"))
    splits = spark.read.parquet(str(tmp_path / "pages.parquet")).rdd.getNumPartitions()
    assert splits > 1
    rows = export_queries.stream_summary(spark, str(tmp_path))
    assert rows.count() == 400
    assert len(rows.inputFiles()) == 4 * splits
