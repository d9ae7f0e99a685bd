"""Exact dedup by a tree of sorted digest runs.

Only DataFrame functions. Each partition of the scan is a run: its distinct
digests in order, each with how many rows hold it and the row that would stay.
Runs meet in rounds: the numbers of those that meet agree but for their last
digit, and what was one row a run becomes one row a merged run, so a group of
copies never brings more than ``fan_in`` rows to a merge, however large it is.
A run is dealt over tasks by its digests, so no task holds a whole one. What a
group's last merge knows returns to its rows by the way of their runs.

Runs are ordered by a 64-bit hash; texts are told apart by SHA-256 and length
in every merge, so two texts that share the hash stay two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import _common as C

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What identifies a text in a run.
_TEXT = ["key", "sha", "n_bytes"]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is. ``lower`` does the same, and faster, where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _merged(runs: DataFrame) -> DataFrame:
    """One row for each run and text: the row that stays, how many hold the text. Spark sorts each task's rows by the keys, merges neighbours, deals and merges again."""
    return runs.groupBy("run", *_TEXT).agg(F.max("top").alias("top"), F.sum("n").alias("n"))


def digest_groups(docs: DataFrame, keep: str = "largest", fan_in: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    ``keep`` names the row that stays, by doc_id. Null text counts as empty,
    and empty texts are equal. Where rows share the doc_id that stays, one of
    them does (which one isn't defined, they differ in nothing that is read).
    A null doc_id stays only where its group has no other. Texts of any length
    are read whole; other columns aren't read; an empty table gives none.

    The digests are written once, as is each round; a round is one shuffle of
    rows of about 70 bytes, at most one for each text and run. ``fan_in`` runs
    meet in a merge, so rounds number log(partitions) / log(fan_in).
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    if fan_in < 2:
        raise ValueError("a merge takes two runs at least")
    space = C.Workspace(docs.sparkSession, "exact")
    d = C.texts(docs).withColumn("text", lower_ascii(F.col("text")))
    # the row that stays is the largest (rank, row); a null rank is the least
    rank = F.col("doc_id") if keep == "largest" else F.bitwise_not("doc_id")
    d = d.select("doc_id", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("key"), F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("n_bytes"))
    rows = space.table(d, "digests")
    leaves = space.table(_merged(rows.select("run", *_TEXT, F.struct(rank.alias("rank"), "row", "doc_id").alias("top"), F.lit(1).cast("long").alias("n"))), "run-0")
    most = leaves.agg(F.max("run")).first()[0] or 0
    top, k = leaves, 0
    while most > 0:
        top = _merged(top.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")))
        most, k = most // fan_in, k + 1
        if most > 0:
            top = space.table(top, f"run-{k}")
    result = top.select(*_TEXT, F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), F.col("n").alias("group_size"))
    # a text has one row a run here, and one row a run and task behind it
    by_run = leaves.select("run", *_TEXT).join(result, _TEXT)
    out = rows.join(by_run, ["run", *_TEXT])
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, keep: str = "largest", fan_in: int = 64) -> DataFrame:
    """The rows of ``docs`` with one row of each group of equal texts, all columns as they are.

    The dropped rows' doc_ids and digests meet the documents by doc_id, one
    document a key. Rows that repeat a doc_id and its text are all kept or all
    dropped.
    """
    columns = docs.columns
    groups = digest_groups(docs, keep, fan_in)
    gone = groups.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias("gone_id"), F.unhex("text_sha256").alias("gone_sha")).distinct()
    packed = docs.select(F.struct(*(docs[c] for c in columns)).alias("r"))
    sha = F.unhex(F.sha2(lower_ascii(F.coalesce(F.col("r.text"), F.lit(""))), 256))
    left = packed.join(gone, F.col("r.doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (sha == F.col("gone_sha")), "left_anti")
    return left.select(*(F.col("r").getField(c).alias(c) for c in columns))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_groups(C.documents(spark, sf_dir))


ORACLE = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
