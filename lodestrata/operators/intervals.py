"""Interval joins and what follows from them: free runs, orphans that come back, loud spans.

Spans are half-open, in seconds of their meeting's clock. Joins are dealt by
meeting and time bucket or block, so the length of a meeting bounds no task.
"""

from __future__ import annotations

from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.params import DEFAULTS
from lodestrata.runtime import settled, ship


def overlapping(a: DataFrame, b: DataFrame, bucket_s: float | None = None) -> DataFrame:
    """All columns of ``a`` and ``b`` (meeting_id, a_lo, a_hi and meeting_id, b_lo, b_hi beside others) for spans that overlap, each pair once: in the bucket where the overlap begins.

    A bucket is as long as the mean span if its length isn't given, so spans
    of any lengths fall into two buckets each on average.
    """
    if bucket_s is None:
        length = lambda d, side: d.select((F.col(f"{side}_hi") - F.col(f"{side}_lo")).alias("l"))
        bucket_s = max(length(a, "a").unionByName(length(b, "b")).filter("l > 0").agg(F.avg("l")).first()[0] or 0.0, 0.01)

    def cut(d: DataFrame, side: str) -> DataFrame:
        first, last = (F.floor(F.col(f"{side}_{end}") / bucket_s).cast("long") for end in ("lo", "hi"))
        return d.filter(F.col(f"{side}_lo") <= F.col(f"{side}_hi")).withColumn("_cell", F.explode(F.sequence(first, last)))

    j = cut(a, "a").join(cut(b, "b"), ["meeting_id", "_cell"])
    begin = F.greatest("a_lo", "b_lo")
    return j.filter((F.col("a_lo") < F.col("b_hi")) & (F.col("b_lo") < F.col("a_hi")) & (F.floor(begin / bucket_s) == F.col("_cell"))).drop("_cell")


def free_runs(spans: DataFrame, bucket_s: float | None = None) -> DataFrame:
    """meeting_id, seg_idx, free_lo, free_hi, clean_s: each span's longest part (of equals the first) in which no other speaker of its meeting talks; null and 0.0 where there is none.

    spans: meeting_id, seg_idx (unique in a meeting), start_s, end_s,
    local_label. What other labels say is cut out of a span; the parts left
    begin where all cuts so far have ended. A span that is empty or reversed
    has no free part; an empty one cuts where it lies, a reversed one nothing.
    """
    s = spans.select("meeting_id", "seg_idx", F.col("start_s").alias("a_lo"), F.col("end_s").alias("a_hi"), F.col("local_label").alias("_who"))
    o = spans.select("meeting_id", F.col("start_s").alias("b_lo"), F.col("end_s").alias("b_hi"), F.col("local_label").alias("_other"))
    cuts = overlapping(s, o, bucket_s).filter(~F.col("_who").eqNullSafe(F.col("_other")))
    cuts = cuts.select("meeting_id", "seg_idx", "a_lo", F.greatest("b_lo", "a_lo").alias("lo"), F.least("b_hi", "a_hi").alias("hi"))
    ends = s.select("meeting_id", "seg_idx", "a_lo", F.col("a_hi").alias("lo"), F.lit(None).cast("double").alias("hi"))  # behind every cut
    before = Window.partitionBy("meeting_id", "seg_idx").orderBy("lo", F.col("hi").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    parts = cuts.unionByName(ends).withColumn("from", F.greatest("a_lo", F.max("hi").over(before)))
    length = F.col("lo") - F.col("from")
    best = F.min(F.when(length > 0, F.struct((-length).alias("l"), F.col("from"), F.col("lo").alias("to"))))
    return parts.groupBy("meeting_id", "seg_idx").agg(best.alias("x")).select("meeting_id", "seg_idx", F.col("x.from").alias("free_lo"), F.col("x.to").alias("free_hi"), F.coalesce(-F.col("x.l"), F.lit(0.0)).alias("clean_s"))


def embed_plan(spans: DataFrame, duration: Column, alone: bool = False, p=DEFAULTS, bucket_s: float | None = None) -> DataFrame:
    """meeting_id, seg_idx, win, local_label, from_s, to_s, dur_used, clean_dur, wanted: where to take each segment's vector from, and which segments get one.

    The span itself, or with ``alone`` its longest free part where it has one,
    is inset at both ends, cut to its middle ``max_dur`` seconds and clipped to
    the recording. ``wanted`` are the ``per_speaker`` longest of a speaker in
    a window (by free seconds with ``alone``, of equals the first) that keep
    ``min_dur`` seconds.
    """
    d = spans.withColumn("_dur", duration).join(free_runs(spans, bucket_s), ["meeting_id", "seg_idx"])
    use_free = F.lit(alone) & F.col("free_lo").isNotNull()
    a, b = F.when(use_free, F.col("free_lo")).otherwise(F.col("start_s")) + p.inset_s, F.when(use_free, F.col("free_hi")).otherwise(F.col("end_s")) - p.inset_s
    d = d.withColumn("_a", a).withColumn("_b", b).withColumn("_mid", (F.col("_a") + F.col("_b")) / 2).withColumn("_long", F.col("_b") - F.col("_a") > p.max_dur)
    lo = F.greatest(F.when(F.col("_long"), F.col("_mid") - p.max_dur / 2).otherwise(F.col("_a")), F.lit(0.0))
    hi = F.least(F.when(F.col("_long"), F.col("_mid") + p.max_dur / 2).otherwise(F.col("_b")), F.col("_dur"))
    d = d.withColumn("from_s", lo).withColumn("to_s", hi).withColumn("dur_used", F.col("to_s") - F.col("from_s"))
    key = F.col("clean_s") if alone else F.col("end_s") - F.col("start_s")
    rank = F.row_number().over(Window.partitionBy("meeting_id", "win", "local_label").orderBy(key.desc(), "seg_idx"))
    few = F.lit(True) if p.per_speaker <= 0 else rank <= p.per_speaker
    return d.withColumn("wanted", few & (F.col("dur_used") >= p.min_dur)).select("meeting_id", "seg_idx", "win", "local_label", "from_s", "to_s", "dur_used", F.col("clean_s").alias("clean_dur"), "wanted")


def orphan_cover(segments: DataFrame, durations: DataFrame | None = None, bucket_s: float | None = None) -> tuple[DataFrame, DataFrame]:
    """What covers each orphan, and the kept segments it touches.

    First: meeting_id, seg_idx, start_s, end_s, n_words, seconds, words (of
    the kept segments that overlap it), island, alone. Orphans of an island
    may bear on each other: they overlap, or touch a kept segment in common.
    Second: meeting_id, seg_idx, kept_idx, k_lo, k_hi, k_words.
    """
    o = segments.filter("NOT owned AND start_s >= 0 AND start_s < end_s")
    if durations is not None:
        o = o.join(durations.select("meeting_id", F.col("duration").alias("_dur")), "meeting_id").filter(F.col("end_s") <= F.col("_dur") + 0.5)
    o = o.select("meeting_id", "seg_idx", F.col("start_s").alias("a_lo"), F.col("end_s").alias("a_hi"), "n_words")
    k = segments.filter("owned").select("meeting_id", F.col("seg_idx").alias("kept_idx"), F.col("start_s").alias("b_lo"), F.col("end_s").alias("b_hi"), F.col("n_words").alias("k_words"))
    touched = overlapping(o, k, bucket_s)
    by = touched.groupBy("meeting_id", "seg_idx").agg(F.sum(F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo")).alias("seconds"), F.sum("k_words").alias("words"), F.min("b_lo").alias("_lo"), F.max("b_hi").alias("_hi"))
    d = o.join(by, ["meeting_id", "seg_idx"], "left").withColumn("_lo", F.least("a_lo", F.coalesce("_lo", "a_lo"))).withColumn("_hi", F.greatest("a_hi", F.coalesce("_hi", "a_hi")))
    line = Window.partitionBy("meeting_id").orderBy("_lo", "seg_idx")  # orphans only
    new = (F.col("_lo") >= F.coalesce(F.max("_hi").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(float("-inf")))).cast("int")
    d = d.withColumn("_new", new).withColumn("island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("alone", F.count("*").over(Window.partitionBy("meeting_id", "island")) == 1)
    cover = d.select("meeting_id", "seg_idx", F.col("a_lo").alias("start_s"), F.col("a_hi").alias("end_s"), "n_words", F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.coalesce("words", F.lit(0)).cast("long").alias("words"), "island", "alone")
    return cover, touched.select("meeting_id", "seg_idx", "kept_idx", F.col("b_lo").alias("k_lo"), F.col("b_hi").alias("k_hi"), "k_words")


def settle(orphans: list[tuple[float, float, int, list[tuple[int, float, float, int]]]], p=DEFAULTS) -> tuple[list[bool], set[int]]:
    """Of orphans in order of start (start, end, words, touched kept segments) which come back, and which kept segments go.

    Covered in seconds and words, an orphan is skipped; in seconds only, what
    it touches goes, even if another orphan that is back rejects it then.
    """
    back: list[bool] = []
    gone: set[int] = set()
    for a, b, words, touched in orphans:
        near = [t for t in touched if t[0] not in gone]
        covered = sum(min(b, hi) - max(a, lo) for _, lo, hi, _ in near) >= p.covered_enough * (b - a)
        if covered and sum(t[3] for t in near) >= p.words_enough * words:
            back.append(False)
            continue
        if covered:
            gone.update(t[0] for t in near)
        back.append(not any(r and x < b and a < y for r, (x, y, *_) in zip(back, orphans, strict=False)))
    return back, gone


def recover_orphans(segments: DataFrame, durations: DataFrame | None = None, p=DEFAULTS, bucket_s: float | None = None) -> DataFrame:
    """meeting_id, seg_idx, start_s, end_s, recovered: kept segments less those that a fuller orphan replaces, and the orphans that come back.

    segments: meeting_id, seg_idx (unique in a meeting), start_s, end_s,
    n_words, owned. durations: meeting_id, duration; orphans that end over
    half a second behind it, or are empty or reversed, stay away.

    Orphans go by start. One is skipped if kept segments cover
    ``covered_enough`` of its seconds and ``words_enough`` of its words;
    covered in seconds only, it replaces those it touches; overlap with an
    orphan that is back already rejects it. Most orphans have no bearing on
    another and are decided by sums alone; only islands of several are folded
    in order, each by itself.
    """
    cover, touched = (settled(d) for d in orphan_cover(segments, durations, bucket_s))  # each is read several times
    full = F.col("seconds") >= p.covered_enough * (F.col("end_s") - F.col("start_s"))
    told = full & (F.col("words") >= p.words_enough * F.col("n_words"))
    single = cover.filter("alone").select("meeting_id", "seg_idx", (~told).alias("back"), (full & ~told).alias("replaces"))
    gone = touched.join(single.filter("replaces").select("meeting_id", "seg_idx"), ["meeting_id", "seg_idx"], "left_semi").select("meeting_id", F.col("kept_idx").alias("seg_idx"))
    lists = touched.groupBy("meeting_id", "seg_idx").agg(F.collect_list(F.struct("kept_idx", "k_lo", "k_hi", "k_words")).alias("near"))
    several = cover.filter("NOT alone").join(lists, ["meeting_id", "seg_idx"], "left").select("meeting_id", "island", "seg_idx", "start_s", "end_s", "n_words", "near")

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["meeting_id", "island", "start_s", "seg_idx"])
        near = [[] if n is None else sorted((t["kept_idx"], t["k_lo"], t["k_hi"], t["k_words"]) for t in n) for n in g.near]
        rows = list(zip(g.meeting_id, g.island, g.seg_idx, g.start_s, g.end_s, g.n_words, near, strict=True))
        out = []
        for (meeting, _), part in groupby(rows, key=lambda r: r[:2]):
            part = list(part)
            back, lost = settle([r[3:] for r in part], p)
            out += [(meeting, r[2], True) for r, ok in zip(part, back, strict=True) if ok] + [(meeting, k, False) for k in sorted(lost)]
        return pd.DataFrame(out, columns=["meeting_id", "seg_idx", "back"])

    ship(segments.sparkSession)
    kinds = dict(segments.dtypes)
    # many islands a group, as each group has a cost of its own
    parts = max(1, -(-cover.filter("NOT alone").count() // 20_000))
    dealt = several.withColumn("part", F.pmod(F.xxhash64("meeting_id", "island"), F.lit(parts)))
    folded = settled(dealt.groupBy("part").applyInPandas(fold, f"meeting_id {kinds['meeting_id']}, seg_idx {kinds['seg_idx']}, back boolean"))
    back = single.filter("back").select("meeting_id", "seg_idx").unionByName(folded.filter("back").select("meeting_id", "seg_idx"))
    gone = gone.unionByName(folded.filter("NOT back").select("meeting_id", "seg_idx"))
    s = segments.select("meeting_id", "seg_idx", "start_s", "end_s", "owned")
    kept = s.filter("owned").join(gone, ["meeting_id", "seg_idx"], "left_anti").withColumn("recovered", F.lit(False))
    found = s.filter("NOT owned").join(back, ["meeting_id", "seg_idx"], "left_semi").withColumn("recovered", F.lit(True))
    return kept.unionByName(found).drop("owned")


#: Runs of blocks: 1, 16, 256, ... frames.
_BASE, _LEVELS = 16, 7


def blocks_of(first: Column, last: Column) -> Column:
    """array<struct<level, block>>: the largest blocks that make up the frames first <= f < last, at most 30 of a size but the largest.

    The silence gate needs one block a segment and no longer uses these runs.
    """
    out, a, b, open_ = [], first, last, first < last
    empty = F.array().cast("array<struct<level:int,block:bigint>>")

    def run(level: int, lo: Column, hi: Column, where: Column) -> Column:
        blocks = F.transform(F.sequence(lo, hi - 1), lambda k: F.struct(F.lit(level).alias("level"), k.alias("block")))
        return F.when(where & (lo < hi), blocks).otherwise(empty)

    for level in range(_LEVELS):
        up, down = F.floor((a + _BASE - 1) / _BASE).cast("long"), F.floor(b / _BASE).cast("long")
        if level == _LEVELS - 1:
            out.append(run(level, a, b, open_))
            break
        more = open_ & (up < down)
        out += [run(level, a, F.when(more, up * _BASE).otherwise(b), open_), run(level, down * _BASE, b, more)]
        a, b, open_ = up, down, more
    return F.concat(*out)


#: Bits of a level of the loudness index: a part is 1, 256, 65536, ... frames, a block 256 parts.
_BITS = 8


def _part(frame: Column, level: Column) -> Column:
    """A frame's part, numbered from the least long, so the last level is one block."""
    return F.call_function("shiftrightunsigned", frame.bitwiseXOR(F.lit(-(2**63))), level * _BITS)


def loud_parts(frames: DataFrame, floor: float, levels: list[int]) -> DataFrame:
    """_meeting, _size, _in_block, _first, _last: the first and last frame (meeting_id, frame, level) of at least ``floor`` in each part of these levels that has one."""
    loud = frames.filter(F.col("level") >= floor).select(F.col("meeting_id").alias("_meeting"), "frame", F.explode(F.array(*map(F.lit, levels))).alias("_size"))
    parts = loud.groupBy("_meeting", "_size", _part(F.col("frame"), F.col("_size")).alias("_part")).agg(F.min("frame").alias("_first"), F.max("frame").alias("_last"))
    return parts.select("_meeting", "_size", F.shiftrightunsigned("_part", _BITS).alias("_in_block"), "_first", "_last")


def silence_gate(segments: DataFrame, frames: DataFrame, floor: float, hop: float) -> DataFrame:
    """Segments (meeting_id, seg_idx, start_s, end_s) that span a frame of at least ``floor``. frames: meeting_id, frame, level.

    A segment is one key, however long it is: the smallest block that holds
    it. Its first and last frame lie in different parts of that block (or are
    one), so the parts' first and last loud frames tell exactly. An end that
    is no number is behind all frames, a start that is none too.
    """
    frame = lambda c: F.floor(F.nanvl(c, F.lit(float("inf"))) / hop).cast("long")
    s = segments.withColumn("_a", frame("start_s")).withColumn("_b", frame("end_s")).filter("_a < _b")
    last = F.greatest("_b", F.lit(-(2**63) + 1)) - 1  # rows that the filter drops may get here too
    differ = F.length(F.hex(F.col("_a").bitwiseXOR(last)))  # two digits a level
    s = s.withColumn("_level", F.floor((differ - 1) / 2).cast("int"))
    s = s.withColumn("_block", F.shiftrightunsigned(_part(F.col("_a"), F.col("_level")), _BITS))
    levels = sorted(r[0] for r in s.select("_level").distinct().collect())  # at most eight; those of no segment need no index
    if not levels:
        return segments.filter(F.lit(False))
    same = (F.col("meeting_id") == F.col("_meeting")) & (F.col("_level") == F.col("_size")) & (F.col("_block") == F.col("_in_block"))
    heard = (F.col("_last") >= F.col("_a")) & (F.col("_first") < F.col("_b"))
    return s.join(loud_parts(frames, floor, levels), same & heard, "left_semi").select(*segments.columns)
