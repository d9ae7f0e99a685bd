"""The engine's relations, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, seg_idx, n_words, start_s, end_s, win, local_label, gid, text: a turn of a conversation speaks 0.4 s a word."""
    c = table(spark, sf_dir, "conversations")
    n = F.coalesce(word_count(F.col("text")), F.lit(0)).cast("long")
    t = F.sum("n_words").over(Window.partitionBy("conv_id").orderBy("turn"))
    role = lambda a, b, c_: F.when(F.col("role") == "user", a).when(F.col("role") == "assistant", b).otherwise(c_)
    d = c.withColumn("n_words", n).withColumn("t", t)
    start = (F.col("t") - F.col("n_words")) * F.lit(0.4)
    return d.select(
        F.col("conv_id").alias("meeting_id"), F.col("turn").alias("seg_idx"), "n_words", start.alias("start_s"), (F.col("t") * F.lit(0.4)).alias("end_s"),
        F.floor(start / 30).cast("long").alias("win"), role("S01", "S02", "S03").alias("local_label"), role("G00", "G01", "G02").alias("gid"), "text",
    )


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, win, local_label, sec, v, label, vec_id: one vector of one speaker in one window."""
    r = F.floor(F.col("vec_id") / 25)
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 25).cast("long").alias("meeting_id"), F.floor(r / 3).cast("long").alias("win"), F.concat(F.lit("S0"), (r % 3 + 1).cast("long").cast("string")).alias("local_label"),
        (1 + (F.col("vec_id") * 7) % 60).cast("double").alias("sec"), F.col("embedding").cast("array<double>").alias("v"), "label", F.col("vec_id").cast("long").alias("vec_id"),
    )


def bank(spark: SparkSession, sf_dir: str, per_person: int = 1) -> DataFrame:
    """person, v, vec_id: the vectors of lowest vec_id of each label."""
    a = atoms(spark, sf_dir)
    w = Window.partitionBy("label").orderBy("vec_id")
    return a.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_person).select(F.col("label").alias("person"), "v", "vec_id", "k")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, seg_idx, start_s, end_s, local_label: events as spans of value * 600 s."""
    e = table(spark, sf_dir, "events").withColumn("d", F.expr("cast(ts AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01 00:00:00'"))  # no session time zone in it
    us = F.expr("(extract(DAY FROM d) * 86400L + extract(HOUR FROM d) * 3600L + extract(MINUTE FROM d) * 60L) * 1000000L + cast(extract(SECOND FROM d) * 1000000 AS BIGINT)")
    s = us / F.lit(1e6)
    return e.select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("seg_idx"), s.alias("start_s"), (s + F.col("value") * 600).alias("end_s"), F.col("event_type").alias("local_label"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, seg_idx, text: a document's lines as a meeting's segments."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("meeting_id"), F.posexplode(F.split("text", "\n")).alias("seg_idx", "text")).withColumn("seg_idx", F.col("seg_idx").cast("long"))


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name: a voice identity of each even label."""
    return table(spark, sf_dir, "embeddings").select("label").distinct().filter("label % 2 = 0").select(F.col("label").cast("long").alias("id"), F.concat(F.lit("Speaker_"), F.col("label").cast("string")).alias("name"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, cluster, seconds, n_atoms, group_id: a label's atoms in a meeting."""
    return atoms(spark, sf_dir).groupBy("meeting_id", F.col("label").cast("long").alias("group_id")).agg(F.sum("sec").alias("seconds"), F.count("*").alias("n_atoms")).withColumn("cluster", F.concat(F.lit("G0"), F.col("group_id").cast("string")))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, speaker_id (null for odd labels)."""
    return table(spark, sf_dir, "embeddings").select("label").distinct().select(F.col("label").cast("long").alias("group_id"), F.when(F.col("label") % 2 == 0, F.col("label")).cast("long").alias("speaker_id"))


def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """speaker_id, condition, v, seconds: the two first vectors of each even label."""
    b = bank(spark, sf_dir, 2).filter("person % 2 = 0")
    return b.select(F.col("person").cast("long").alias("speaker_id"), F.when(F.col("k") == 1, "room").otherwise("phone").alias("condition"), "v", (1 + (F.col("vec_id") * 7) % 60).cast("double").alias("seconds"))
