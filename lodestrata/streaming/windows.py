"""The batch operators over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type. On a stream, rows later than ``late`` behind the newest are dropped."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def hopping(events: DataFrame, size: str = "30 minutes", step: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def enrol(stream: DataFrame, known: DataFrame, sink: str, checkpoint: str, accept: float):
    """Names each arriving atom by its best person in ``known`` and appends to ``sink``; what is there already ends the query."""
    from lodestrata.operators.matching import margins, scores

    def step(batch: DataFrame, n: int) -> None:
        best = margins(scores(batch, known)).withColumn("named", F.col("sim") >= accept)
        best.write.mode("overwrite").parquet(f"{sink}/batch={n}")  # a batch that runs again replaces itself

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
