"""Queries over spans in time (free runs, orphans, loudness), transcripts, cuts and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import cuts, intervals, recovery, reports, selection
from lodestrata.plans.registry import SEG, SPAN, query
from lodestrata.sources import tables as S

_FREE = f"""WITH {SPAN}, cut AS (SELECT a.meeting_id, a.seg_idx, a.start_s AS a, greatest(b.start_s, a.start_s) AS lo, least(b.end_s, a.end_s) AS hi FROM span a JOIN span b ON a.meeting_id = b.meeting_id AND a.local_label <> b.local_label AND a.start_s < b.end_s AND b.start_s < a.end_s),
al AS (SELECT * FROM cut UNION ALL SELECT meeting_id, seg_idx, start_s, end_s, NULL FROM span),
part AS (SELECT *, greatest(a, coalesce(max(hi) OVER (PARTITION BY meeting_id, seg_idx ORDER BY lo, hi NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)) AS beg FROM al),
best AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, seg_idx ORDER BY lo - beg DESC, beg) AS k FROM part WHERE lo > beg)"""


@query("free_runs", f"{_FREE} SELECT s.meeting_id, s.seg_idx, round(beg, 3) AS free_lo, round(lo, 3) AS free_hi, round(coalesce(lo - beg, 0), 3) AS clean_s FROM span s LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (meeting_id, seg_idx)")
def _(spark, d):
    r = intervals.free_runs(S.intervals(spark, d))
    return r.select("meeting_id", "seg_idx", *(F.round(c, 3).alias(c) for c in ("free_lo", "free_hi", "clean_s")))


_PLAN = """, used AS (SELECT meeting_id, seg_idx, s.start_s AS s0, local_label, coalesce(beg, start_s) + 0.2::DOUBLE AS a, coalesce(lo, end_s) - 0.2::DOUBLE AS b, coalesce(lo - beg, 0) AS clean FROM span s LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (meeting_id, seg_idx)),
lim AS (SELECT meeting_id, min(start_s) AS base, max(end_s) - 3600 AS dur FROM span GROUP BY 1),
mid AS (SELECT *, CASE WHEN b - a > 20 THEN (a + b) / 2 - 10 ELSE a END AS f, CASE WHEN b - a > 20 THEN (a + b) / 2 + 10 ELSE b END AS t, row_number() OVER (PARTITION BY meeting_id, floor(s0 / 7200), local_label ORDER BY clean DESC, seg_idx) AS k FROM used JOIN lim USING (meeting_id))
SELECT meeting_id, seg_idx, round(greatest(f, 0.0), 3) AS from_s, round(least(t, dur), 3) AS to_s, round(clean, 3) AS clean_dur, k <= 2 AND least(t, dur) - greatest(f, 0.0) >= 0.5 AS wanted FROM mid"""


@query("embed_plan", _FREE + _PLAN)
def _(spark, d):
    s = S.intervals(spark, d).withColumn("win", F.floor(F.col("start_s") / 7200))
    m = s.groupBy("meeting_id").agg((F.max("end_s") - 3600).alias("duration"))
    e = intervals.embed_plan(s.join(m, "meeting_id"), F.col("duration"), alone=True)
    return e.select("meeting_id", "seg_idx", *(F.round(c, 3).alias(c) for c in ("from_s", "to_s", "clean_dur")), "wanted")


# two thirds of the spans are kept, the others orphans; a recording ends an hour before its last span does
_CORE = f"""{SPAN}, dur AS (SELECT meeting_id, max(end_s) - 3600 AS d FROM span GROUP BY 1), w AS (SELECT *, 1 + seg_idx % 11 AS n_words, seg_idx % 3 <> 0 AS owned FROM span),
orph AS (SELECT w.*, row_number() OVER (PARTITION BY meeting_id ORDER BY start_s, seg_idx) AS k FROM w JOIN dur USING (meeting_id) WHERE NOT owned AND start_s < end_s AND end_s <= d + 0.5),
near AS (SELECT o.meeting_id, o.seg_idx, k.seg_idx AS id, k.start_s AS lo, k.end_s AS hi, k.n_words AS n FROM orph o JOIN w k ON o.meeting_id = k.meeting_id AND k.owned AND o.start_s < k.end_s AND k.start_s < o.end_s)"""


def _cores(spark, d):
    s = S.intervals(spark, d).withColumn("n_words", 1 + F.col("seg_idx") % 11).withColumn("owned", F.col("seg_idx") % 3 != 0)
    return s, s.groupBy("meeting_id").agg((F.max("end_s") - 3600).alias("duration"))


@query(
    "orphan_islands",
    f"""WITH {_CORE}, c AS (SELECT o.meeting_id, o.seg_idx, coalesce(sum(least(o.end_s, hi) - greatest(o.start_s, lo)) FILTER (WHERE hi IS NOT NULL), 0) AS seconds, coalesce(sum(n), 0)::BIGINT AS words, least(o.start_s, min(lo)) AS lo, greatest(o.end_s, max(hi)) AS hi FROM orph o LEFT JOIN near USING (meeting_id, seg_idx) GROUP BY o.meeting_id, o.seg_idx, o.start_s, o.end_s),
i AS (SELECT *, sum(CASE WHEN lo < m THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY lo, seg_idx)::BIGINT AS island FROM (SELECT *, max(hi) OVER (PARTITION BY meeting_id ORDER BY lo, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM c))
SELECT meeting_id, seg_idx, round(seconds, 3) AS seconds, words, island, count(*) OVER (PARTITION BY meeting_id, island) = 1 AS alone FROM i""",
)
def _(spark, d):
    cover, _ = intervals.orphan_cover(*_cores(spark, d))
    return cover.select("meeting_id", "seg_idx", F.round("seconds", 3).alias("seconds"), "words", "island", "alone")


@query(
    "recovered_orphans",
    f"""WITH RECURSIVE {_CORE}, o AS (SELECT meeting_id, k, seg_idx, start_s AS a, end_s AS b, n_words AS n, coalesce(l, []) AS l FROM orph LEFT JOIN (SELECT meeting_id, seg_idx, list({{'id': id, 'lo': lo, 'hi': hi, 'n': n}} ORDER BY id) AS l FROM near GROUP BY ALL) USING (meeting_id, seg_idx)),
r AS (SELECT meeting_id, 0::BIGINT AS k, []::BIGINT[] AS gone, []::STRUCT(a DOUBLE, b DOUBLE, id BIGINT)[] AS back FROM dur
UNION ALL SELECT meeting_id, k, CASE WHEN cov AND NOT told THEN list_concat(gone, list_transform(t, lambda x: x.id)) ELSE gone END,
  CASE WHEN told OR len(list_filter(back, lambda x: x.a < b AND a < x.b)) > 0 THEN back ELSE list_append(back, {{'a': a, 'b': b, 'id': seg_idx}}) END
  FROM (SELECT *, coalesce(list_sum(list_transform(t, lambda x: least(b, x.hi) - greatest(a, x.lo))), 0) >= 0.5 * (b - a) AS cov, coalesce(list_sum(list_transform(t, lambda x: least(b, x.hi) - greatest(a, x.lo))), 0) >= 0.5 * (b - a) AND coalesce(list_sum(list_transform(t, lambda x: x.n)), 0) >= 0.8 * n AS told
    FROM (SELECT o.*, gone, back, list_filter(l, lambda x: NOT list_contains(gone, x.id)) AS t FROM r JOIN o ON o.meeting_id = r.meeting_id AND o.k = r.k + 1))),
e AS (SELECT meeting_id, arg_max(gone, k) AS gone, arg_max(back, k) AS back FROM r GROUP BY 1)
SELECT meeting_id, seg_idx, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s, NOT owned AS recovered FROM w JOIN e USING (meeting_id) WHERE CASE WHEN owned THEN NOT list_contains(gone, seg_idx) ELSE len(list_filter(back, lambda x: x.id = seg_idx)) > 0 END""",
)
def _(spark, d):
    return intervals.recover_orphans(*_cores(spark, d)).withColumn("start_s", F.round("start_s", 3)).withColumn("end_s", F.round("end_s", 3))


@query("silence_gate", f"WITH {SPAN}, fr AS (SELECT meeting_id, floor(start_s / 600)::BIGINT AS frame, count(*) AS level FROM span GROUP BY ALL) SELECT meeting_id, seg_idx FROM span s WHERE EXISTS (SELECT 1 FROM fr WHERE fr.meeting_id = s.meeting_id AND level >= 1 AND frame >= floor(s.start_s / 600) AND frame < floor(s.end_s / 600))")
def _(spark, d):
    s = S.intervals(spark, d)
    frames = s.groupBy("meeting_id", F.floor(F.col("start_s") / 600).cast("long").alias("frame")).agg(F.count("*").alias("level"))
    return intervals.silence_gate(s, frames, 1, 600.0).select("meeting_id", "seg_idx")


@query("loud_spans", f"WITH {SPAN}, fr AS (SELECT meeting_id, floor(start_s / 20)::BIGINT AS frame, max(end_s - start_s) AS level FROM span GROUP BY ALL) SELECT meeting_id, seg_idx FROM span s WHERE EXISTS (SELECT 1 FROM fr WHERE fr.meeting_id = s.meeting_id AND level >= 60000 AND frame >= floor(s.start_s / 20) AND frame < floor(s.end_s / 20))")
def _(spark, d):
    s = S.intervals(spark, d)
    frames = s.groupBy("meeting_id", F.floor(F.col("start_s") / 20).cast("long").alias("frame")).agg(F.max(F.col("end_s") - F.col("start_s")).alias("level"))
    return intervals.silence_gate(s, frames, 60000.0, 20.0).select("meeting_id", "seg_idx")


# --- transcripts ---

# every third turn has no tag, every seventh is closed by text, every eleventh has no timestamps
_RAW = r"""raw AS (SELECT conv_id AS meeting_id, string_agg(CASE WHEN turn % 11 = 10 THEN text ELSE '[' || turn || '.5]' || CASE WHEN turn % 3 = 1 THEN ' ' ELSE '[S0' || (turn % 4 + 1) || ']' END || replace(text, '[', '(') || '[' || (turn + 1) || ']' || CASE WHEN turn % 7 = 6 THEN ' more' ELSE chr(10) END END, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""


def _raw(spark, d):
    c, t = S.table(spark, d, "conversations"), F.col("turn").cast("string")
    tag = F.when(F.col("turn") % 3 == 1, " ").otherwise(F.concat(F.lit("[S0"), (F.col("turn") % 4 + 1).cast("string"), F.lit("]")))
    piece = F.concat(F.lit("["), t, F.lit(".5]"), tag, F.replace("text", F.lit("["), F.lit("(")), F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("]"), F.when(F.col("turn") % 7 == 6, " more").otherwise("\n"))
    return c.withColumn("t", F.when(F.col("turn") % 11 == 10, F.col("text")).otherwise(piece)).groupBy(F.col("conv_id").alias("meeting_id")).agg(F.expr("listagg(t, '') WITHIN GROUP (ORDER BY turn)").alias("text"))


_FIXED = rf"""{_RAW}, tok AS (SELECT meeting_id, unnest(regexp_extract_all(text, '\[[^\]]*\]|[^\[]+|\[')) AS x, generate_subscripts(regexp_extract_all(text, '\[[^\]]*\]|[^\[]+|\['), 1) AS i FROM raw),
seen AS (SELECT *, lead(x) OVER (PARTITION BY meeting_id ORDER BY i) AS nx, last_value(CASE WHEN regexp_full_match(x, '\[S\d+\]') THEN x END IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY i) AS tag FROM tok),
need AS (SELECT *, regexp_full_match(x, '\[\d+(\.\d+)?\]') AND nx IS NOT NULL AND NOT starts_with(nx, '[') AND trim(nx, '{T.SPACES}') <> '' AS lacks FROM seen),
fixed AS (SELECT meeting_id, string_agg(x || CASE WHEN lacks THEN coalesce(tag, '[S01]') ELSE '' END, '' ORDER BY i) AS text, count(*) FILTER (WHERE lacks)::INT AS n_repaired FROM need GROUP BY meeting_id)"""


@query("repaired_tags", f"WITH {_FIXED} SELECT * FROM fixed")
def _(spark, d):
    return recovery.repair_generations(_raw(spark, d))


# a turn in five has no timestamps at all, the others only lack tags
_LOOSE = "CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN ' ' WHEN 2 THEN '[0.5]' || replace(text, '[', '(') || '[1.5]' WHEN 3 THEN '[' || turn || '][S01]' || replace(text, '[', '(') || '[' || (turn + 1) || ']' ELSE '[S02]' || text END"


@query("retried_generations", f"SELECT conv_id AS meeting_id, turn AS win FROM conversations WHERE turn % 5 IN (0, 4) AND trim({_LOOSE}) <> ''")
def _(spark, d):
    t, plain = F.col("turn").cast("string"), F.replace("text", F.lit("["), F.lit("("))
    kinds = [F.col("text"), F.lit(" "), F.concat(F.lit("[0.5]"), plain, F.lit("[1.5]")), F.concat(F.lit("["), t, F.lit("][S01]"), plain, F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("]")), F.concat(F.lit("[S02]"), F.col("text"))]
    text = F.element_at(F.array(*kinds), (F.col("turn") % 5 + 1).cast("int"))
    return selection.to_retry(S.table(spark, d, "conversations").select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("win"), text.alias("text"))).select("meeting_id", "win")


# --- references to meetings ---

_WANTED = ("7", " supplier-3/", "SUPPLIER-3-12", "Supplier 0-9", "zzz", "", "#000000004", "lib/x-5", "PPLIER-1-1", "x")


@query(
    "resolve_meetings",
    f"""WITH m AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey = 5 THEN 'x-5' ELSE 'supplier-' || s_nationkey || '-' || s_suppkey END AS folder, s_name AS title FROM supplier), w AS (SELECT unnest({list(_WANTED)}) AS ref),
c AS (SELECT ref, id, folder, CASE WHEN 'lib/' || folder = r THEN 0 WHEN id::VARCHAR = r OR folder = r THEN 1 WHEN regexp_replace(folder, '-[^-]*$', '') = r THEN 2 WHEN contains(lower(folder), lower(r)) OR contains(lower(title), lower(r)) THEN 3 END AS tier FROM m, (SELECT ref, rtrim(trim(ref), '/') AS r FROM w)),
f AS (SELECT ref, tier, count(*) AS n, arg_min(id, folder) AS id, row_number() OVER (PARTITION BY ref ORDER BY tier) AS k FROM c WHERE tier IS NOT NULL GROUP BY ref, tier)
SELECT w.ref, CASE WHEN n = 1 OR tier <= 1 THEN id END AS meeting_id FROM w LEFT JOIN f ON w.ref = f.ref AND k = 1""",
)
def _(spark, d):
    folder = F.when(F.col("s_suppkey") == 5, "x-5").otherwise(F.concat_ws("-", F.lit("supplier"), F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")))
    m = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("meeting_id"), folder.alias("folder"), F.col("s_name").alias("title")).withColumn("path", F.concat(F.lit("lib/"), "folder"))
    return reports.resolve(m, spark.createDataFrame([(x,) for x in _WANTED], "ref string"))


# --- cuts ---

# a forest over each meeting's atoms: chains of up to three, halved above
_MERGE = """node AS (SELECT vec_id % 25 AS meeting_id, vec_id AS node, vec_id // 25 AS r FROM embeddings), mg AS (SELECT meeting_id, CASE WHEN r % 4 = 0 THEN r - 1 ELSE r // 2 END * 25 + meeting_id AS a, node AS b, ((node * 7919) % 1009) / 1009.0::DOUBLE AS height FROM node WHERE r > 0),
merge_ AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY height DESC, b) - 1 AS step FROM mg),
gp AS (SELECT *, nx - height AS gap FROM (SELECT *, lead(height) OVER (PARTITION BY meeting_id ORDER BY height, step) AS nx FROM merge_)),
rk AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY gap DESC NULLS LAST, height) AS k FROM gp),
cut AS (SELECT meeting_id, CASE WHEN count(*) < 3 THEN 0.2656 ELSE max((height + nx) / 2) FILTER (WHERE k = 1) END AS threshold, CASE WHEN count(*) < 3 THEN 0 ELSE max(height) - min(height) END AS span, CASE WHEN count(*) < 3 THEN 0 ELSE max(gap) FILTER (WHERE k = 1) / greatest(max(gap) FILTER (WHERE k = 2), 1e-9) END AS dominance FROM rk GROUP BY meeting_id)"""


def _merges(spark, d):
    from pyspark.sql import Window

    n = S.table(spark, d, "embeddings").select((F.col("vec_id") % 25).alias("meeting_id"), F.col("vec_id").alias("node"), F.floor(F.col("vec_id") / 25).alias("r"))
    up = F.when(F.col("r") % 4 == 0, F.col("r") - 1).otherwise(F.floor(F.col("r") / 2)) * 25 + F.col("meeting_id")
    m = n.filter("r > 0").select("meeting_id", up.alias("a"), F.col("node").alias("b"), (F.col("node") * 7919 % 1009 / F.lit(1009.0)).alias("height"))
    return n, m.withColumn("step", F.row_number().over(Window.partitionBy("meeting_id").orderBy(F.desc("height"), "b")) - 1)


@query("gap_cuts", f"WITH {_MERGE} SELECT meeting_id, round(threshold, 9) AS threshold, round(span, 9) AS span, round(dominance, 6) AS dominance, span < 0.25 OR dominance < 2 AS low_separation FROM cut")
def _(spark, d):
    c = cuts.gap_cuts(_merges(spark, d)[1])
    return c.select("meeting_id", F.round("threshold", 9).alias("threshold"), F.round("span", 9).alias("span"), F.round("dominance", 6).alias("dominance"), "low_separation")


_REPLAY = """, used AS (SELECT m.* FROM merge_ m JOIN lim USING (meeting_id) WHERE step < coalesce((SELECT min(step) FROM merge_ x WHERE x.meeting_id = m.meeting_id AND x.height < lim.threshold), 1000000)),
r AS (SELECT meeting_id, node, node AS root FROM node UNION ALL SELECT r.meeting_id, r.node, used.a FROM r JOIN used ON used.meeting_id = r.meeting_id AND used.b = r.root),
t AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM used WHERE used.meeting_id = r.meeting_id AND used.b = r.root)),
f AS (SELECT *, min(node) OVER (PARTITION BY meeting_id, root) AS f FROM t)
SELECT meeting_id, node, dense_rank() OVER (PARTITION BY meeting_id ORDER BY f) - 1 AS label FROM f"""


@query("cut_labels", f"WITH RECURSIVE {_MERGE}, lim AS (SELECT * FROM cut){_REPLAY}")
def _(spark, d):
    n, m = _merges(spark, d)
    return cuts.labels_at(n, m, cuts.gap_cuts(m))


@query("half_cut_labels", f"WITH RECURSIVE {_MERGE}, lim AS (SELECT DISTINCT meeting_id, 0.5 AS threshold FROM node){_REPLAY}")
def _(spark, d):
    n, m = _merges(spark, d)
    return cuts.labels_at(n, m, n.select("meeting_id", F.lit(0.5).alias("threshold")).distinct())


# --- against a reference ---

# windows of the last fifth have no cluster, S03 shares one with S01
_VOICE = f"""{SEG}, cl AS (SELECT meeting_id, seg_idx, win, local_label, start_s, end_s, CASE WHEN win % 5 = 4 THEN NULL WHEN local_label = 'S03' THEN 'G00' ELSE gid END AS gid FROM seg WHERE end_s > start_s),
rt AS (SELECT meeting_id, gid AS speaker, start_s + 3 AS lo, end_s + 5 AS hi FROM seg WHERE end_s > start_s AND seg_idx % 4 <> 3),
o AS (SELECT cl.meeting_id, win, local_label, speaker, sum(least(end_s, hi) - greatest(start_s, lo)) AS s FROM cl JOIN rt ON cl.meeting_id = rt.meeting_id AND start_s < hi AND lo < end_s GROUP BY ALL),
b AS (SELECT meeting_id, win, local_label, arg_min(speaker, (-s, speaker)) AS speaker, max(s) AS top_s, sum(s) AS ref_s FROM o GROUP BY ALL),
v AS (SELECT c.meeting_id, c.win, c.local_label, coalesce(c.gid, 'UNASSIGNED') AS gid, speaker, coalesce(top_s, 0) AS top_s, coalesce(ref_s, 0) AS ref_s, greatest(c.al - coalesce(ref_s, 0), 0) AS off_s FROM (SELECT meeting_id, win, local_label, max(gid) AS gid, sum(end_s - start_s) AS al FROM cl GROUP BY ALL) c LEFT JOIN b USING (meeting_id, win, local_label)),
cell AS (SELECT meeting_id, gid, speaker, sum(ref_s) AS seconds, CASE WHEN grouping(speaker) = 1 THEN sum(off_s) END AS off_s FROM v GROUP BY GROUPING SETS ((meeting_id, gid, speaker), (meeting_id, gid), (meeting_id, speaker), (meeting_id)) HAVING grouping(speaker) = 1 OR speaker IS NOT NULL)"""


def _voices(spark, d):
    s = S.segments(spark, d).filter("end_s > start_s")
    t = s.filter("seg_idx % 4 <> 3").select("meeting_id", F.col("gid").alias("speaker"), (F.col("start_s") + 3).alias("start_s"), (F.col("end_s") + 5).alias("end_s"))
    own = s.withColumn("gid", F.when(F.col("win") % 5 == 4, None).when(F.col("local_label") == "S03", "G00").otherwise(F.col("gid")))
    return reports.voices_against(own, t, bucket_s=60.0), t


def _rounded(d, *names):
    return d.select(*(F.round(c, 3).alias(c) if c in names else c for c in d.columns))


@query("confusion_cells", f"WITH {_VOICE} SELECT meeting_id, gid, speaker, round(seconds, 3) AS seconds, round(off_s, 3) AS off_s FROM cell")
def _(spark, d):
    return _rounded(reports.confusion_cells(_voices(spark, d)[0]), "seconds", "off_s")


@query("cluster_purity", f"WITH {_VOICE}, p AS (SELECT meeting_id, gid, max(seconds) AS m, arg_min(speaker, (-seconds, speaker)) AS top FROM cell WHERE gid IS NOT NULL AND speaker IS NOT NULL AND seconds > 0 GROUP BY ALL) SELECT meeting_id, gid, round(seconds, 3) AS ref_s, round(off_s, 3) AS off_s, round(m / seconds, 3) AS purity, top FROM cell LEFT JOIN p USING (meeting_id, gid) WHERE gid IS NOT NULL AND speaker IS NULL AND (seconds > 0 OR off_s > 0)")
def _(spark, d):
    return _rounded(reports.cluster_purity(reports.confusion_cells(_voices(spark, d)[0])), "ref_s", "off_s", "purity")


@query("speaker_recall", f"WITH {_VOICE}, p AS (SELECT meeting_id, speaker, sum(seconds) AS captured, max(seconds) AS m, arg_min(gid, (-seconds, gid = 'UNASSIGNED', gid)) AS best_cluster FROM cell WHERE gid IS NOT NULL AND speaker IS NOT NULL AND seconds > 0 GROUP BY ALL), al AS (SELECT meeting_id, speaker, sum(hi - lo) AS ref_s FROM rt GROUP BY ALL) SELECT meeting_id, speaker, round(ref_s, 3) AS ref_s, round(coalesce(captured, 0), 3) AS captured, best_cluster, round(coalesce(m / captured, 0), 3) AS best_frac FROM al LEFT JOIN p USING (meeting_id, speaker)")
def _(spark, d):
    v, t = _voices(spark, d)
    return _rounded(reports.speaker_recall(reports.confusion_cells(v), t), "ref_s", "captured", "best_frac")


@query("local_purity", f"WITH {_VOICE} SELECT meeting_id, round(avg(top_s / ref_s), 3) AS mean, round(median(top_s / ref_s), 3) AS median, round(avg(CASE WHEN top_s / ref_s < 0.8 THEN 1 ELSE 0 END), 3) AS below FROM v WHERE ref_s > 0 GROUP BY meeting_id")
def _(spark, d):
    return _rounded(reports.local_purity(_voices(spark, d)[0]), "mean", "median", "below")
