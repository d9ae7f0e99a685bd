"""From windowed generations to one clean, ordered relation of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import normal_line
from lodestrata.params import DEFAULTS


def _by(*order: str):
    return Window.partitionBy("meeting_id").orderBy(*order)


def rebase(segments: DataFrame, window_s: float = DEFAULTS.window_s) -> DataFrame:
    """Window-local times to the meeting's clock: round(offset + t, 2)."""
    offset = F.col("win") * F.lit(window_s)
    return segments.withColumn("start_s", F.round(offset + F.col("start_in"), 2)).withColumn("end_s", F.round(offset + F.col("end_in"), 2))


def core_owned(segments: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Adds ``owned``: lo <= midpoint < hi; the others are orphans."""
    mid = (F.col("start_s") + F.col("end_s")) / 2
    return segments.withColumn("owned", (mid >= lo) & (mid < hi))


def well_formed(segments: DataFrame, duration: Column) -> DataFrame:
    return segments.filter((F.col("start_s") >= 0) & (F.col("start_s") < F.col("end_s")) & (F.col("end_s") <= duration + 0.5))


def clamp_ends(segments: DataFrame, duration: Column) -> DataFrame:
    return segments.withColumn("end_s", F.least("end_s", F.round(duration, 2)))


def repetition_guard(segments: DataFrame, least: int = 4) -> DataFrame:
    """Of ``least`` or more neighbours of equal text (case and outer space aside) only the first stays."""
    by = _by("seg_idx")
    key = normal_line(F.col("text"))
    d = segments.withColumn("_k", key).withColumn("_new", (~F.col("_k").eqNullSafe(F.lag("_k").over(by))).cast("int"))
    d = d.withColumn("_run", F.sum("_new").over(by))
    run = Window.partitionBy("meeting_id", "_run")
    d = d.withColumn("_n", F.count("*").over(run)).withColumn("_i", F.row_number().over(run.orderBy("seg_idx")))
    return d.filter((F.col("_n") < least) | (F.col("_i") == 1)).drop("_k", "_new", "_run", "_n", "_i")


def seam_overlap(a: Column, b: Column, least: int = 3, most: int = 10) -> Column:
    """How many words the tail of ``a`` (words, folded) shares with the head of ``b``: the longest length from most down to least, below b's length; 0 if none."""
    top = F.least(F.lit(most), F.size(a), F.size(b) - 1)
    lengths = F.when(top >= least, F.sequence(top, F.lit(least))).otherwise(F.array().cast("array<int>"))
    hits = F.filter(lengths, lambda n: F.slice(a, F.size(a) - n + 1, n) == F.slice(b, F.lit(1), n))
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(0))


def seams(chunks: DataFrame) -> DataFrame:
    """Adds ``overlap``: words at a chunk's head that the chunk before it, of another window, ends with. chunks: meeting_id, win, words."""
    folded = F.transform("words", lambda w: F.lower(F.regexp_replace(w, r"^[.,?!]+|[.,?!]+$", "")))
    d = chunks.withColumn("_w", folded).withColumn("_before", F.lag("_w").over(_by("win")))
    return d.withColumn("overlap", F.when(F.col("_before").isNull(), 0).otherwise(seam_overlap(F.col("_before"), F.col("_w")))).drop("_w", "_before")


def coverage(segments: DataFrame, speech_end: DataFrame) -> DataFrame:
    """min(max(end) / max(speech_end, 1), 1), 0 without segments; by meeting. The largest end counts, not the last segment's."""
    last = segments.groupBy("meeting_id").agg(F.max("end_s").alias("_last"))
    share = F.least(F.col("_last") / F.greatest(F.col("speech_end"), F.lit(1.0)), F.lit(1.0))
    return speech_end.join(last, "meeting_id", "left").select("meeting_id", F.round(F.coalesce(share, F.lit(0.0)), 4).alias("coverage"))


def windows_of(spans: DataFrame, size: float, step: float) -> DataFrame:
    """Hopping windows (tumbling if step = size): a row for each window [k*step, k*step + size) a span's start lies in."""
    first = F.greatest(F.floor((F.col("start_s") - F.lit(size)) / step) + 1, F.lit(0)).cast("long")
    last = F.floor(F.col("start_s") / step).cast("long")
    return spans.withColumn("k", F.explode(F.sequence(first, last)))


def slide_windows(recordings: DataFrame, shared: float, size: float = DEFAULTS.window_s) -> DataFrame:
    """meeting_id, win, audio_lo, audio_hi, core_lo: windows of ``size`` seconds that share ``shared`` with the one before, which owns them. recordings: meeting_id, duration. A rest under a second is no window."""
    if not 0 <= shared < size:
        raise ValueError("windows can't share all their seconds")
    step = F.lit(size - shared)
    last = F.floor((F.col("duration") - 1) / step)
    d = recordings.filter("duration >= 1").select("meeting_id", "duration", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("win"))
    lo = F.col("win") * step
    return d.select("meeting_id", "win", lo.alias("audio_lo"), F.least(lo + size, "duration").alias("audio_hi"), (lo + F.when(F.col("win") == 0, 0.0).otherwise(shared)).alias("core_lo"))


def single_window(recordings: DataFrame, most: float = DEFAULTS.single_pass_s, none: float = DEFAULTS.window_s) -> DataFrame:
    """window_s: one window for the longest recording, at most ``most``; ``none`` if no duration is known."""
    longest = F.max(F.when(F.col("duration") > 0, F.col("duration")))
    return recordings.agg(F.when(longest.isNull(), none).otherwise(F.least(longest, F.lit(most))).alias("window_s"))


def complete_recordings(decoded: DataFrame, planned: DataFrame) -> DataFrame:
    """meeting_id, n_windows, n_decoded, complete: a recording is complete when all its planned windows (meeting_id, win) are back, whatever batch brought them."""
    have = decoded.select("meeting_id", "win", F.lit(1).alias("_d")).distinct()
    j = planned.select("meeting_id", "win").distinct().join(have, ["meeting_id", "win"], "left")
    d = j.groupBy("meeting_id").agg(F.count("*").alias("n_windows"), F.count("_d").alias("n_decoded"))
    return d.withColumn("complete", F.col("n_windows") == F.col("n_decoded"))


def turns(segments: DataFrame) -> DataFrame:
    """Neighbouring segments of one speaker as one turn: meeting_id, turn, local_label, start_s, end_s, n."""
    changed = (~F.col("local_label").eqNullSafe(F.lag("local_label").over(_by("start_s", "seg_idx")))).cast("int")
    d = segments.withColumn("_c", changed).withColumn("turn", F.sum("_c").over(_by("start_s", "seg_idx")))
    return d.groupBy("meeting_id", "turn", "local_label").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n"))


def speaker_overlaps(spans: DataFrame, bucket_s: float | None = None) -> DataFrame:
    """Overlaps of each span with spans of other speakers in its meeting: meeting_id, seg_idx, local_label, dur, other_idx, reference (the other's label), seconds.

    Half-open intervals. Both sides are dealt by meeting and time bucket, so
    that a long meeting is no single join group; an overlap is taken in the
    bucket of its begin. A bucket is as long as the mean span if its length
    isn't given, so a span makes two rows on average.
    """
    if bucket_s is None:
        length = F.abs(F.col("end_s") - F.col("start_s"))
        bucket_s = max(spans.filter(length > 0).agg(F.avg(length)).first()[0] or 0.0, 0.01)
    cells = F.sequence(*(F.floor(end("start_s", "end_s") / bucket_s).cast("long") for end in (F.least, F.greatest)))
    a = spans.filter("start_s is not null and end_s is not null").withColumn("cell", F.explode(cells)).select("meeting_id", "cell", "seg_idx", "start_s", "end_s", "local_label")
    b = a.select("meeting_id", "cell", *(F.col(c).alias(f"o_{c}") for c in ("seg_idx", "start_s", "end_s", "local_label")))
    begin = F.greatest("start_s", "o_start_s")
    j = a.join(b, ["meeting_id", "cell"]).filter((F.col("local_label") != F.col("o_local_label")) & (F.col("start_s") < F.col("o_end_s")) & (F.col("o_start_s") < F.col("end_s")) & (F.floor(begin / bucket_s) == F.col("cell")))
    return j.select("meeting_id", "seg_idx", "local_label", (F.col("end_s") - F.col("start_s")).alias("dur"), F.col("o_seg_idx").alias("other_idx"), F.col("o_local_label").alias("reference"), (F.least("end_s", "o_end_s") - begin).alias("seconds"))


def other_speakers(spans: DataFrame, bucket_s: float | None = None) -> DataFrame:
    """meeting_id, seg_idx, other_idx, seconds of ``speaker_overlaps``."""
    return speaker_overlaps(spans, bucket_s).select("meeting_id", "seg_idx", "other_idx", "seconds")


def free_run(spans: DataFrame) -> DataFrame:
    """By meeting, the gaps in which nobody speaks: a running maximum of ends before each start. meeting_id, seg_idx, gap_s."""
    before = F.max("end_s").over(_by("start_s", "seg_idx").rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("gap_s", F.greatest(F.col("start_s") - before, F.lit(0.0))).select("meeting_id", "seg_idx", "gap_s")


def embed_spans(spans: DataFrame, p=DEFAULTS) -> DataFrame:
    """The part of each span to take a vector from: both ends inset, the middle ``max_dur`` seconds, at least ``min_dur``."""
    a, b = F.col("start_s") + p.inset_s, F.col("end_s") - p.inset_s
    mid, long_ = (a + b) / 2, (b - a) > p.max_dur
    out = spans.withColumn("_a", F.when(long_, mid - p.max_dur / 2).otherwise(a)).withColumn("_b", F.when(long_, mid + p.max_dur / 2).otherwise(b))
    return out.filter(F.col("_b") - F.col("_a") >= p.min_dur).withColumn("from_s", F.col("_a")).withColumn("to_s", F.col("_b")).drop("_a", "_b")


def reference_overlap(segments: DataFrame, reference: DataFrame, *keys: str, bucket_s: float = 600.0) -> DataFrame:
    """keys, speaker, seconds: how long segments (meeting_id, start_s, end_s and ``keys``) and a reference's turns (meeting_id, speaker, start_s, end_s) overlap; speaker is null for seconds in no turn.

    Both are dealt by meeting and time bucket; an overlap counts in the bucket where it begins.
    """
    cut = lambda d: d.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_s") / bucket_s).cast("long"), F.floor(F.col("end_s") / bucket_s).cast("long"))))
    s = segments.filter("end_s > start_s").select("meeting_id", "start_s", "end_s", *(k for k in keys if k != "meeting_id"))
    t = cut(reference.filter("end_s > start_s")).select("meeting_id", "_b", "speaker", F.col("start_s").alias("_lo"), F.col("end_s").alias("_hi"))
    lo, hi = F.greatest("start_s", "_lo"), F.least("end_s", "_hi")
    found = cut(s).join(t, ["meeting_id", "_b"]).filter((lo < hi) & (F.floor(lo / bucket_s) == F.col("_b")))
    by = found.groupBy(*keys, "speaker").agg(F.sum(hi - lo).alias("seconds"))
    heard = by.groupBy(*keys).agg(F.sum("seconds").alias("_in"))
    total = s.groupBy(*keys).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("_all"))
    off = total.join(heard, list(keys), "left").select(*keys, F.lit(None).cast("string").alias("speaker"), F.greatest(F.col("_all") - F.coalesce("_in", F.lit(0.0)), F.lit(0.0)).alias("seconds"))
    return by.unionByName(off.filter("seconds > 1e-9"))
