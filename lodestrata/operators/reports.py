"""Reports over segments, voices and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import SPACES, hms
from lodestrata.operators import assembly
from lodestrata.params import DEFAULTS


def speaker_totals(segments: DataFrame) -> DataFrame:
    return segments.filter(~F.coalesce(F.col("gid").startswith("G-"), F.lit(True))).groupBy("meeting_id", "gid").agg(F.sum("n_words").alias("words"), F.count("*").alias("n"), F.min("seg_idx").alias("first_idx"))


def speaker_ordinals(segments: DataFrame) -> DataFrame:
    """Speaker 1, 2, ... of a meeting by words; ties by first appearance."""
    w = Window.partitionBy("meeting_id").orderBy(F.desc("words"), "first_idx")
    return speaker_totals(segments).withColumn("k", F.row_number().over(w)).select("meeting_id", "gid", F.concat(F.lit("Speaker "), F.col("k").cast("string")).alias("shown"), "words")


def dense_labels(segments: DataFrame) -> DataFrame:
    """Labels numbered by first appearance in the meeting."""
    d = segments.groupBy("meeting_id", "gid").agg(F.min("seg_idx").alias("first_idx"))
    return d.select("meeting_id", "gid", (F.dense_rank().over(Window.partitionBy("meeting_id").orderBy("first_idx")) - 1).cast("long").alias("k"))


def longest_turns(segments: DataFrame, n: int = DEFAULTS.clips, p=DEFAULTS) -> DataFrame:
    """A speaker's longest n turns of at least 1.5 s, cut to 12 s."""
    d = segments.withColumn("dur", F.col("end_s") - F.col("start_s")).filter(F.col("dur") >= p.clip_min)
    w = Window.partitionBy("meeting_id", "gid").orderBy(F.desc("dur"), "seg_idx")
    return d.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).select("meeting_id", "gid", "seg_idx", F.round(F.least("dur", F.lit(p.clip_max)), 3).alias("clip_s"))


def transcript(segments: DataFrame) -> DataFrame:
    """meeting_id, text: a heading wherever the speaker changes, then what was said."""
    by = Window.partitionBy("meeting_id").orderBy("seg_idx")
    head = ~F.col("gid").eqNullSafe(F.lag("gid").over(by))
    line = F.concat(F.when(head, F.concat(F.lit("\n"), "gid", F.lit(":\n"))).otherwise(F.lit("")), "text")
    return segments.withColumn("line", line).groupBy("meeting_id").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY seg_idx)").alias("text"))


def shown_speakers(segments: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """meeting_id, gid, shown, seconds: a given name (names: meeting_id, gid, name), else Speaker 1, 2, ... by seconds among all speakers of the meeting (of equals the first to appear), else UNKNOWN. Leftover labels (G-...) and null are UNKNOWN."""
    real = F.col("gid").isNotNull() & ~F.startswith("gid", F.lit("G-"))
    d = segments.groupBy("meeting_id", "gid").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"), F.min("seg_idx").alias("_first"))
    w = Window.partitionBy("meeting_id", real).orderBy(F.desc("seconds"), "_first")
    d = d.withColumn("_k", F.row_number().over(w))
    if names is None:
        d = d.withColumn("name", F.lit(None).cast("string"))
    else:
        d = d.join(names.select("meeting_id", "gid", "name"), ["meeting_id", "gid"], "left")
    shown = F.coalesce("name", F.when(real, F.concat(F.lit("Speaker "), F.col("_k").cast("string"))), F.lit("UNKNOWN"))
    return d.select("meeting_id", "gid", shown.alias("shown"), "seconds", F.col("name").isNotNull().alias("named"))


def render_transcripts(segments: DataFrame, meetings: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """meeting_id, text: the transcript as people read it.

    Title, minutes, turns and speakers on top; then a heading with the time
    wherever the shown speaker changes, and every segment's text below it.
    segments: meeting_id, seg_idx, start_s, end_s, gid, text. meetings:
    meeting_id, title, duration.
    """
    who = shown_speakers(segments, names)
    real = F.col("gid").isNotNull() & ~F.startswith("gid", F.lit("G-"))
    count = who.groupBy("meeting_id").agg(F.count_if(real).alias("_n"), F.count_if(real & F.col("named")).alias("_named"))
    d = segments.join(who.select("meeting_id", F.col("gid").alias("_g"), "shown"), (F.col("_g").eqNullSafe(F.col("gid"))) & (who["meeting_id"] == segments["meeting_id"])).select(segments["*"], "shown")
    changed = ~F.col("shown").eqNullSafe(F.lag("shown").over(Window.partitionBy("meeting_id").orderBy("seg_idx")))
    head = F.when(changed, F.concat(F.lit("\n["), hms(F.col("start_s")), F.lit("] "), "shown", F.lit("\n"))).otherwise("")
    d = d.withColumn("_line", F.concat(head, F.lit("  "), "text"))
    body = d.groupBy("meeting_id").agg(F.count("*").alias("_turns"), F.expr("listagg(_line, '\n') WITHIN GROUP (ORDER BY seg_idx)").alias("_body"))
    tally = F.concat(F.col("_n").cast("string"), F.lit(" speakers"), F.when(F.col("_named") > 0, F.concat(F.lit(", "), F.col("_named").cast("string"), F.lit(" named"))).otherwise(""))
    top = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.format_string("%.1f", F.col("duration") / 60), F.lit(" min · "), F.col("_turns").cast("string"), F.lit(" turns · "), tally, F.lit("\n" + "=" * 66 + "\n"))
    return meetings.join(body, "meeting_id").join(count, "meeting_id").select("meeting_id", F.concat(top, "_body", F.lit("\n")).alias("text"))


def text_samples(segments: DataFrame, chars: int = 200, least: int = 60) -> DataFrame:
    """A speaker's words in order, the first 200 characters, if over 60."""
    d = segments.groupBy("meeting_id", "gid").agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY seg_idx)").alias("t"))
    return d.select("meeting_id", "gid", F.substring("t", 1, chars).alias("sample")).filter(F.length("sample") > least)


def review_queue(clusters: DataFrame, groups: DataFrame, least: float = DEFAULTS.min_link_sec, n: int = 15) -> DataFrame:
    """Unnamed voices by distinct meetings, then seconds: a top-n report."""
    d = clusters.join(groups.filter("speaker_id is null"), "group_id")
    d = d.groupBy("group_id").agg(F.count("*").alias("n_clusters"), F.count_distinct("meeting_id").alias("meetings"), F.sum("seconds").alias("seconds")).filter(F.col("seconds") >= least)
    return d.orderBy(F.desc("meetings"), F.desc("seconds"), "group_id").limit(n)


def group_report(groups: DataFrame, clusters: DataFrame, speakers: DataFrame) -> DataFrame:
    """group_id, name, n_clusters, meetings, seconds of every group, empty ones too; callers order by meetings and n_clusters, most first."""
    d = groups.join(clusters, "group_id", "left").join(speakers, groups["speaker_id"] == speakers["id"], "left")
    return d.groupBy("group_id", "name").agg(F.count("cluster").alias("n_clusters"), F.count_distinct("meeting_id").alias("meetings"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))


def speaker_list(speakers: DataFrame, exemplars: DataFrame) -> DataFrame:
    """id, name, conditions, seconds of every speaker's exemplars; callers order by name."""
    d = speakers.join(exemplars, speakers["id"] == exemplars["speaker_id"], "left")
    return d.groupBy("id", "name").agg(F.count("condition").alias("conditions"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))


def inherited_names(clusters: DataFrame, groups: DataFrame, share: float = DEFAULTS.name_inherit_share) -> DataFrame:
    """meeting_id, speaker_id: the speaker with at least ``share`` of a meeting's seconds; ties go to the larger id."""
    d = clusters.join(groups, "group_id").groupBy("meeting_id", "speaker_id").agg(F.sum("seconds").alias("s"))
    d = d.withColumn("share", F.col("s") / F.sum("s").over(Window.partitionBy("meeting_id"))).filter("speaker_id is not null")
    w = Window.partitionBy("meeting_id").orderBy(F.desc("s"), F.desc("speaker_id"))
    return d.withColumn("k", F.row_number().over(w)).filter((F.col("k") == 1) & (F.col("share") >= share)).select("meeting_id", "speaker_id", F.round("share", 6).alias("share"))


def inherited_groups(members: DataFrame, groups: DataFrame, share: float = DEFAULTS.name_inherit_share) -> DataFrame:
    """link, group_id, speaker_id, share: the named group whose name a new link of clusters takes on: that of the speaker with most of the link's seconds (of equals the one with the larger group, and of a speaker's groups the first met), if ``share`` of them or more.

    members: link, id, seconds, group_id (before; null: none). groups: group_id, speaker_id.
    """
    d = members.join(groups.filter("speaker_id IS NOT NULL"), "group_id", "left")
    by = d.groupBy("link", "speaker_id").agg(F.sum("seconds").alias("_s"), F.min_by("group_id", "id").alias("group_id"))
    by = by.withColumn("_all", F.sum("_s").over(Window.partitionBy("link"))).filter("speaker_id IS NOT NULL")
    best = by.groupBy("link").agg(F.max(F.struct("_s", "group_id", "speaker_id", "_all")).alias("x")).select("link", "x.*")
    return best.withColumn("share", F.col("_s") / F.when(F.col("_all") > 0, F.col("_all")).otherwise(1.0)).filter(F.col("share") >= share).select("link", "group_id", "speaker_id", "share")


def channel_vote(events: DataFrame) -> DataFrame:
    """user_id, kind (majority; ties: the one that sorts first), agreement, median value of the majority's rows."""
    by = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.percentile("value", F.lit(0.5)).alias("m"))
    w = Window.partitionBy("user_id")
    top = by.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "event_type"))).withColumn("all", F.sum("n").over(w)).filter("k = 1")
    return top.select("user_id", F.col("event_type").alias("kind"), F.round(F.col("n") / F.col("all"), 6).alias("agreement"), F.round("m", 6).alias("median_value"))


def confusion(labelled: DataFrame, values: list[str]) -> DataFrame:
    """Seconds of each local label by reference speaker, as columns."""
    return labelled.groupBy("meeting_id").pivot("gid", values).agg(F.sum("n_words"))


def voices_against(segments: DataFrame, reference: DataFrame, bucket_s: float = 600.0) -> DataFrame:
    """meeting_id, win, local_label, gid, speaker, top_s, ref_s, off_s: each voice of a window, the reference speaker it overlaps longest (of equals the one that sorts first), how long, how long any, and how long none.

    segments: meeting_id, win, local_label, start_s, end_s, gid (null: UNASSIGNED).
    reference: meeting_id, speaker, start_s, end_s.
    """
    key = ["meeting_id", "win", "local_label"]
    over = assembly.reference_overlap(segments, reference, *key, bucket_s=bucket_s)
    best = F.min(F.when(F.col("speaker").isNotNull(), F.struct((-F.col("seconds")).alias("s"), "speaker")))
    by = over.groupBy(*key).agg(best.alias("x"), F.coalesce(F.sum(F.when(F.col("speaker").isNotNull(), F.col("seconds"))), F.lit(0.0)).alias("ref_s"), F.coalesce(F.sum(F.when(F.col("speaker").isNull(), F.col("seconds"))), F.lit(0.0)).alias("off_s"))
    own = segments.groupBy(*key).agg(F.coalesce(F.max("gid"), F.lit("UNASSIGNED")).alias("gid"))
    return own.join(by, key).select(*key, "gid", "x.speaker", F.coalesce(-F.col("x.s"), F.lit(0.0)).alias("top_s"), "ref_s", "off_s")


def confusion_cells(voices: DataFrame) -> DataFrame:
    """meeting_id, gid, speaker, seconds, off_s: reference seconds of clusters by the speaker each of their voices is, with margins (null gid: all clusters; null speaker: all speakers, and there the seconds off the reference)."""
    d = voices.groupingSets([["meeting_id", "gid", "speaker"], ["meeting_id", "gid"], ["meeting_id", "speaker"], ["meeting_id"]], "meeting_id", "gid", "speaker")
    d = d.agg(F.sum("ref_s").alias("seconds"), F.sum("off_s").alias("off"), F.grouping("speaker").alias("_all"))
    return d.filter("_all = 1 OR speaker IS NOT NULL").select("meeting_id", "gid", "speaker", "seconds", F.when(F.col("_all") == 1, F.col("off")).alias("off_s"))


def cluster_purity(cells: DataFrame) -> DataFrame:
    """meeting_id, gid, ref_s, off_s, purity, top: of each cluster the share and name of its main speaker; null without reference seconds."""
    own = cells.filter("gid IS NOT NULL AND speaker IS NULL").select("meeting_id", "gid", F.col("seconds").alias("ref_s"), "off_s").filter("ref_s > 0 OR off_s > 0")
    top = cells.filter("gid IS NOT NULL AND speaker IS NOT NULL AND seconds > 0").groupBy("meeting_id", "gid").agg(F.min(F.struct((-F.col("seconds")).alias("s"), "speaker")).alias("x"))
    return own.join(top, ["meeting_id", "gid"], "left").select("meeting_id", "gid", "ref_s", "off_s", (-F.col("x.s") / F.col("ref_s")).alias("purity"), F.col("x.speaker").alias("top"))


def speaker_recall(cells: DataFrame, reference: DataFrame) -> DataFrame:
    """meeting_id, speaker, ref_s, captured, best_cluster, best_frac: how much of each reference speaker's captured seconds went to the cluster that holds most (of equals the first; UNASSIGNED is last); null and 0 if nothing was captured."""
    total = reference.groupBy("meeting_id", "speaker").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("ref_s"))
    own = cells.filter("gid IS NOT NULL AND speaker IS NOT NULL AND seconds > 0")
    best = own.groupBy("meeting_id", "speaker").agg(F.sum("seconds").alias("captured"), F.min(F.struct((-F.col("seconds")).alias("s"), (F.col("gid") == "UNASSIGNED").alias("last"), "gid")).alias("x"))
    d = total.join(best, ["meeting_id", "speaker"], "left")
    return d.select("meeting_id", "speaker", "ref_s", F.coalesce("captured", F.lit(0.0)).alias("captured"), F.col("x.gid").alias("best_cluster"), F.coalesce(-F.col("x.s") / F.col("captured"), F.lit(0.0)).alias("best_frac"))


def pool_stats(pooled: DataFrame, least: float = DEFAULTS.min_core) -> DataFrame:
    """meeting_id, n_labels, embeddable, empty, core, median_s, total_s of pooled voices (meeting_id, n, seconds): those with and without a vector, and those of ``least`` seconds."""
    return pooled.groupBy("meeting_id").agg(F.count("*").alias("n_labels"), F.count_if(F.col("n") > 0).alias("embeddable"), F.count_if(F.col("n") == 0).alias("empty"), F.count_if(F.col("seconds") >= least).alias("core"), F.median("seconds").alias("median_s"), F.sum("seconds").alias("total_s"))


def store_counts(clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """clusters, grouped, groups, named_groups, named_meetings: what the store holds, in one row."""
    named = groups.filter("speaker_id IS NOT NULL").select("group_id", F.lit(True).alias("_named"))
    c = clusters.join(named, "group_id", "left").agg(F.count("*").alias("clusters"), F.count("group_id").alias("grouped"), F.count_distinct(F.when(F.col("_named"), F.col("meeting_id"))).alias("named_meetings"))
    g = groups.agg(F.count("*").alias("groups"), F.count("speaker_id").alias("named_groups"))
    return c.join(F.broadcast(g), how="cross").select("clusters", "grouped", "groups", "named_groups", "named_meetings")  # one row each


def meetings_of_names(clusters: DataFrame, groups: DataFrame, speakers: DataFrame) -> DataFrame:
    """name, meetings: in how many meetings each speaker is heard, 0 included."""
    heard = clusters.join(groups.filter("speaker_id IS NOT NULL"), "group_id").groupBy("speaker_id").agg(F.count_distinct("meeting_id").alias("_n"))
    return speakers.join(heard, speakers["id"] == heard["speaker_id"], "left").select("name", F.coalesce("_n", F.lit(0)).alias("meetings"))


def local_purity(voices: DataFrame, low: float = 0.8) -> DataFrame:
    """meeting_id, mean, median, below: how pure the voices of single windows are, and the share of those under ``low``."""
    d = voices.filter("ref_s > 0").withColumn("_p", F.col("top_s") / F.col("ref_s"))
    return d.groupBy("meeting_id").agg(F.avg("_p").alias("mean"), F.median("_p").alias("median"), F.avg((F.col("_p") < low).cast("double")).alias("below"))


def resolve(meetings: DataFrame, wanted: DataFrame, most: int = 10_000) -> DataFrame:
    """ref, meeting_id: the meeting meant by each reference, null if none is or several may be.

    meetings: meeting_id, folder (``stem-id``), title and, if known, path. By
    the folder's path; else by exact id or folder name; else by the stem, which
    recordings of one title share; else by a part of folder or title in any
    case. The first of these that fits decides, even if it fits several;
    blank ends and a closing slash don't count.

    wanted is a list of references typed by users, broadcast after a check of its size.
    """
    if wanted.limit(most + 1).count() > most:
        raise ValueError("too many references")
    m = meetings.select(F.col("meeting_id").cast("string").alias("id"), "folder", F.regexp_replace("folder", "-[^-]*$", "").alias("stem"), F.lower("folder").alias("low"), F.lower("title").alias("low_title"), (F.col("path") if "path" in meetings.columns else F.lit(None).cast("string")).alias("path"), F.col("meeting_id"))
    w = wanted.select("ref", F.regexp_replace(F.btrim("ref", F.lit(SPACES)), "/+$", "").alias("r"))
    tier = F.when(F.col("path") == F.col("r"), 0).when((F.col("id") == F.col("r")) | (F.col("folder") == F.col("r")), 1).when(F.col("stem") == F.col("r"), 2).when(F.contains("low", F.lower("r")) | F.contains("low_title", F.lower("r")), 3)
    hits = m.join(F.broadcast(w), tier.isNotNull()).withColumn("tier", tier)
    by = hits.groupBy("ref", "tier").agg(F.count("*").alias("n"), F.min(F.struct("folder", "meeting_id")).alias("first"))
    best = by.groupBy("ref").agg(F.min(F.struct("tier", "n", "first")).alias("x"))
    one = F.when((F.col("x.n") == 1) | (F.col("x.tier") <= 1), F.col("x.first.meeting_id"))
    return wanted.join(best, "ref", "left").select("ref", one.alias("meeting_id"))


def manifest_lookup(files: DataFrame, manifest: DataFrame, default: str) -> DataFrame:
    """A file's glossary: by full name, else by stem, else the default; an empty entry counts as none."""
    m = manifest.select("key", F.when(F.col("glossary") != "", F.col("glossary")).alias("g"))
    d = files.join(m.select(F.col("key").alias("name"), F.col("g").alias("by_name")), "name", "left").join(m.select(F.col("key").alias("stem"), F.col("g").alias("by_stem")), "stem", "left")
    return d.select("name", F.coalesce("by_name", "by_stem", F.lit(default)).alias("glossary"))


def name_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, change: gained, lost or changed between two maps (key, name)."""
    a, b = before.select("key", F.col("name").alias("old")), after.select("key", F.col("name").alias("new"))
    change = F.when(F.col("old").isNull(), "gained").when(F.col("new").isNull(), "lost").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "key", "full").withColumn("change", change).filter("change is not null").select("key", "change")
