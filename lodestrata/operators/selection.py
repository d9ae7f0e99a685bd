"""Picking segments, voices and windows: predicates, lookups and small aggregates over single relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import SPACES
from lodestrata.operators.matching import pool
from lodestrata.operators.recovery import parse_tagged, repair_tags
from lodestrata.params import DEFAULTS


def in_roster(bank: DataFrame, roster: DataFrame | None, key: str) -> DataFrame:
    """The bank's rows whose ``key`` is in the roster; no roster, or an empty one, means everyone."""
    if roster is None or roster.isEmpty():
        return bank
    return bank.join(roster.select(key).distinct(), key, "left_semi")


def channel_hint(voices: DataFrame, kind: str, min_share: float = 0.8) -> DataFrame:
    """Unnamed voices (``auto-`` names) heard on one channel ``kind`` for at least ``min_share`` of their time: the channel may be what was clustered."""
    return voices.filter(F.startswith("name", F.lit("auto-")) & (F.col("share") >= min_share) & (F.col("kind") == kind))


def to_retry(generations: DataFrame) -> DataFrame:
    """Generations with text that parse to no tagged piece even when their tags are repaired."""
    return generations.filter((F.btrim("text", F.lit(SPACES)) != "") & (F.size(parse_tagged(repair_tags(F.col("text"))["text"])) == 0))


def capped_windows(generations: DataFrame) -> DataFrame:
    """meeting_id, windows: sorted windows whose generation ended at the token cap."""
    return generations.filter(F.col("finish_reason") == "length").groupBy("meeting_id").agg(F.sort_array(F.collect_set("win")).alias("windows"))


def refuse_clips(path: Column) -> Column:
    """The path itself; an error if one of its folders is ``clips``."""
    return F.when(F.array_contains(F.split(path, "/"), "clips"), F.raise_error(F.concat(F.lit("a clip is no recording: "), path))).otherwise(path)


def labels_to_segments(segments: DataFrame, labels: DataFrame) -> DataFrame:
    """Each segment's label by (meeting_id, win, local_label), null where there is none.

    Both sides must agree on the number of segments: ``labels`` carries
    n_segments, and a key whose count differs raises an error, as does one
    that no segment has.
    """
    key = ["meeting_id", "win", "local_label"]
    held = segments.groupBy(*key).agg(F.count("*").alias("_n"))
    j = segments.withColumn("_here", F.lit(True)).join(labels.join(held, key, "left"), key, "full")
    wrong = F.col("_here").isNull() | (F.col("n_segments") != F.col("_n"))
    where = F.concat_ws(" ", F.lit("segments and labels differ in number at"), *(F.col(k).cast("string") for k in key))
    return j.filter(F.when(wrong, F.raise_error(where).cast("boolean")).otherwise(True)).drop("_here", "_n", "n_segments")


def vectors_to_segments(segments: DataFrame, vectors: DataFrame) -> DataFrame:
    """Segments that have a vector, by (meeting_id, seg_idx)."""
    return segments.join(vectors, ["meeting_id", "seg_idx"])


def pool_all(segments: DataFrame, vectors: DataFrame, *keys: str) -> DataFrame:
    """keys, seconds (of the used spans), n, v: as ``pool``, and keys without vectors keep a row with no seconds and a zero vector."""
    size = F.max(F.size("v")).alias("_size")
    j = vectors_to_segments(segments.select("meeting_id", "seg_idx", *(k for k in keys if k != "meeting_id")), vectors)
    sums = j.groupBy(*keys).agg(F.sum("dur_used").alias("seconds"), F.count("*").alias("n"))
    found = sums.join(pool(j, *keys), list(keys))
    rows = segments.select(*keys).distinct().join(found, list(keys), "left").join(F.broadcast(vectors.agg(size)), how="cross")  # one row
    zero = F.array_repeat(F.lit(0.0), F.coalesce("_size", F.lit(0)))
    return rows.select(*keys, F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("v", zero).alias("v"))


def frame_levels(samples: DataFrame, hop: int) -> DataFrame:
    """meeting_id, frame, db: the root mean square of each ``hop`` samples (meeting_id, i, x) in decibels, at least -120."""
    e = samples.groupBy("meeting_id", F.floor(F.col("i") / hop).cast("long").alias("frame")).agg(F.avg(F.col("x") * F.col("x")).alias("_p"))
    return e.select("meeting_id", "frame", F.greatest(10 * F.log10(F.greatest("_p", F.lit(1e-12))), F.lit(-120.0)).alias("db"))


def speech_end(frames: DataFrame, frame_s: float = 0.01, silence_db: float = DEFAULTS.silence_db, durations: DataFrame | None = None) -> DataFrame:
    """meeting_id, speech_end: where the last frame of at least ``silence_db`` begins; the whole duration if none reaches it.

    durations: meeting_id, duration; without it a recording ends with its last frame.
    """
    d = frames.groupBy("meeting_id").agg(F.max(F.when(F.col("db") >= silence_db, F.col("frame"))).alias("_last"), ((F.max("frame") + 1) * F.lit(frame_s)).alias("duration"))
    if durations is not None:
        d = durations.select("meeting_id", "duration").join(d.drop("duration"), "meeting_id", "left")
    return d.select("meeting_id", F.coalesce(F.col("_last") * F.lit(frame_s), F.col("duration")).alias("speech_end"))


def busy_shares(phases: DataFrame) -> DataFrame:
    """phase, busy_s, share: summed seconds of each phase (meeting_id, phase, seconds) and their share of all work."""
    b = phases.groupBy("phase").agg(F.sum("seconds").alias("busy_s"))
    all_work = b.agg(F.sum("busy_s").alias("_all"))  # one row
    return b.join(F.broadcast(all_work), how="cross").select("phase", "busy_s", F.when(F.col("_all") > 0, F.col("busy_s") / F.col("_all")).otherwise(0.0).alias("share"))


def top_segments(segments: DataFrame, n: int) -> DataFrame:
    """The ``n`` longest segments of each (meeting_id, win, local_label), earlier ones first among equals; all if ``n`` isn't positive."""
    if n <= 0:
        return segments
    w = Window.partitionBy("meeting_id", "win", "local_label").orderBy(F.desc("dur"), "seg_idx")
    return segments.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def next_auto_index(names: DataFrame, prefix: str = "auto-") -> DataFrame:
    """next: one more than the highest number behind ``prefix`` in ``name``, 1 if there is none."""
    k = F.regexp_extract("name", f"^{prefix}(\\d+)$", 1)
    return names.agg((F.coalesce(F.max(F.when(k != "", k.cast("long"))), F.lit(0)) + 1).cast("long").alias("next"))


def weak_atoms(atoms: DataFrame, core: DataFrame, min_core: float = DEFAULTS.min_core) -> DataFrame:
    """Atoms shorter than ``min_core`` that the core set doesn't hold, by vec_id."""
    return atoms.filter(F.col("sec") < min_core).join(core.select("vec_id"), "vec_id", "left_anti")


def weak_suspects(members: DataFrame, below: float = 0.5, least: float = DEFAULTS.min_link_sec, n: int = 10) -> DataFrame:
    """The ``n`` members (speaker_id, id, seconds, sim to their profile) of ``least`` seconds that fit worst, if under ``below``: probably somebody else."""
    return members.filter((F.col("sim") < below) & (F.col("seconds") >= least)).orderBy("sim", "id").limit(n)


def of_model(vectors: DataFrame, model: str | None) -> DataFrame:
    """The rows whose ``embed_model`` is ``model``: vectors of several models can't be compared. None: all."""
    return vectors if model is None else vectors.filter(F.col("embed_model") == model)


def linkable(clusters: DataFrame, model: str | None, least: float = DEFAULTS.min_link_sec) -> DataFrame:
    """Clusters of one model with enough speech to take part in linking."""
    return of_model(clusters, model).filter(F.col("seconds") >= least)


def named_bank(exemplars: DataFrame, speakers: DataFrame, model: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """name, person, condition, v, seconds: one model's exemplars of the speakers who have a name; only of those in ``names`` (name), if it has any."""
    who = in_roster(speakers.filter("name IS NOT NULL"), names, "name").select(F.col("id").alias("person"), "name")
    return of_model(exemplars, model).withColumnRenamed("speaker_id", "person").join(who, "person").select("name", "person", "condition", "v", "seconds")


def register_functions(spark: SparkSession) -> None:
    """dot, unit_vector, fold_name, hms and slug for SQL in this session; Catalyst inlines them."""
    d = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {d}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION unit_vector(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN CASE WHEN aggregate(a, 0D, (s, x) -> s + x * x) > 0 THEN transform(a, x -> x / sqrt(aggregate(a, 0D, (s, y) -> s + y * y))) ELSE a END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fold_name(name STRING) RETURNS STRING RETURN regexp_replace(lower(name), '[^a-z0-9]+', '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hms(seconds DOUBLE) RETURNS STRING RETURN concat(cast(floor(seconds / 3600) AS STRING), ':', lpad(cast(floor(seconds % 3600 / 60) AS STRING), 2, '0'), ':', lpad(cast(floor(seconds % 60) AS STRING), 2, '0'))")
    # slug's rule as an expression over its argument, the one of ``functions.text``
    words = r"slice(filter(split(regexp_replace(lower(title), '(?U)[^\\w\\s-]+', ' '), '(?U)[\\s_-]+'), w -> w <> ''), 1, 5)"
    longer = "CASE WHEN acc.s = '' THEN w ELSE concat(acc.s, '-', w) END"
    full = f"acc.full OR (acc.s <> '' AND length({longer}) > 40)"
    cut = f"aggregate({words}, named_struct('s', '', 'full', false), (acc, w) -> named_struct('s', CASE WHEN {full} THEN acc.s ELSE {longer} END, 'full', {full}), acc -> CASE WHEN acc.s = '' THEN 'meeting' ELSE acc.s END)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION slug(title STRING) RETURNS STRING RETURN {cut}")
