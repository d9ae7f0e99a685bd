"""Outputs that are acknowledged by their paths, at least once.

An output is written first and acknowledged after, so what a crash leaves
between the two is an output without an ack: the next run makes it again over
the old one. The ledger is a table that only grows; the last row of an output
counts. ``reset`` forgets what an earlier run acknowledged before outputs of
the same paths are made again, so no stale ack is taken for a new one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.runtime import names_in, settled

_SCHEMA = "output string, status string, run long"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """output, status (ok, failed or reset), run: the last word on each output."""
    if not names_in(spark, path):
        return spark.createDataFrame([], _SCHEMA)
    w = Window.partitionBy("output").orderBy(F.desc("run"))
    return spark.read.schema(_SCHEMA).parquet(path).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def next_run(spark: SparkSession, path: str) -> int:
    return ledger(spark, path).agg(F.coalesce(F.max("run"), F.lit(0)) + 1).first()[0]


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    """output: those that have a file."""
    if not any(n.startswith("output=") for n, _ in names_in(spark, folder)):
        return spark.createDataFrame([], "output string")
    return spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(folder).select(F.url_decode(F.regexp_extract("path", r"/output=([^/]+)/[^/]+$", 1)).alias("output")).distinct()


def unfinished(jobs: DataFrame, acks: DataFrame, files: DataFrame) -> DataFrame:
    """The jobs (output, ...) without an ok or without a file."""
    done = acks.filter("status = 'ok'").join(files, "output", "left_semi")
    return jobs.join(done.select("output"), "output", "left_anti")


def publish(results: DataFrame, folder: str, path: str) -> None:
    """Writes each result (output, value; null: failed) as a text of its own and acknowledges it. Outputs that exist are replaced, others stay.

    ``output`` is part of a folder's name; a value is written whole, by one task.
    """
    spark = results.sparkSession
    run = next_run(spark, path)
    results = settled(results.select("output", "value"))  # made once, before any file of theirs is replaced
    results.filter("value IS NOT NULL").repartition("output").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("output").text(folder)
    results.select("output", F.when(F.col("value").isNull(), "failed").otherwise("ok").alias("status"), F.lit(run).cast("long").alias("run")).distinct().write.mode("append").parquet(path)


def reset(jobs: DataFrame, path: str) -> None:
    """Forgets the acks of these outputs."""
    run = next_run(jobs.sparkSession, path)
    jobs.select("output", F.lit("reset").alias("status"), F.lit(run).cast("long").alias("run")).distinct().write.mode("append").parquet(path)


def drain(jobs: DataFrame, path: str) -> DataFrame:
    """output, ok of those jobs that are acknowledged since the last reset."""
    acks = ledger(jobs.sparkSession, path).filter("status <> 'reset'")
    return jobs.select("output").distinct().join(acks, "output").select("output", (F.col("status") == "ok").alias("ok"))


def run_pending(jobs: DataFrame, make, folder: str, path: str) -> int:
    """Makes what is unfinished with ``make`` (jobs to output, value), publishes it, and tells how many there were."""
    spark = jobs.sparkSession
    left = settled(unfinished(jobs, ledger(spark, path), outputs(spark, folder)))
    n = left.count()
    if n:
        publish(make(left), folder, path)
    return n
