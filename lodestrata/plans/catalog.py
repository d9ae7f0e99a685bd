"""Every query of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import assembly, clustering, identity, linking, matching, profiles, recovery, reports, selection, store
from lodestrata.params import DEFAULTS
from lodestrata.plans import people, timeline  # noqa: F401  their queries
from lodestrata.plans.registry import ATOM as _ATOM
from lodestrata.plans.registry import LINES as _LINES
from lodestrata.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from lodestrata.plans.registry import SEG as _SEG
from lodestrata.plans.registry import SPAN as _SPAN
from lodestrata.plans.registry import STORE as _STORE
from lodestrata.sources import tables as S
from lodestrata.streaming import windows

# --- segments ---


@query("segments", f"WITH {_SEG} SELECT meeting_id, seg_idx, n_words, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s, win, local_label, gid FROM seg")
def _(spark, d):
    return S.segments(spark, d).select("meeting_id", "seg_idx", "n_words", F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "win", "local_label", "gid")


@query("rebase_core", f"WITH {_SEG} SELECT meeting_id, win, count(*) FILTER (WHERE (start_s + end_s) / 2 < win * 30 + 30) AS owned, count(*) FILTER (WHERE (start_s + end_s) / 2 >= win * 30 + 30) AS orphans FROM seg GROUP BY ALL")
def _(spark, d):
    s = S.segments(spark, d).withColumn("start_in", F.col("start_s") - F.col("win") * 30.0).withColumn("end_in", F.col("end_s") - F.col("win") * 30.0)
    o = assembly.core_owned(assembly.rebase(s), F.col("win") * 30.0, F.col("win") * 30.0 + 30)
    return o.groupBy("meeting_id", "win").agg(F.count(F.when(F.col("owned"), 1)).alias("owned"), F.count(F.when(~F.col("owned"), 1)).alias("orphans"))


@query("well_formed_clamped", f"WITH {_SEG}, m AS (SELECT meeting_id, max(end_s) - 1 AS dur FROM seg GROUP BY 1) SELECT meeting_id, seg_idx, round(least(end_s, round(dur, 2)), 3) AS end_s FROM seg JOIN m USING (meeting_id) WHERE start_s >= 0 AND start_s < end_s AND end_s <= dur + 0.5")
def _(spark, d):
    s = S.segments(spark, d)
    m = s.groupBy("meeting_id").agg((F.max("end_s") - 1).alias("dur"))
    x = assembly.clamp_ends(assembly.well_formed(s.join(m, "meeting_id"), F.col("dur")), F.col("dur"))
    return x.select("meeting_id", "seg_idx", F.round("end_s", 3).alias("end_s"))


@query("speaker_totals", f"WITH {_SEG} SELECT meeting_id, gid, sum(n_words)::BIGINT AS words, count(*) AS n, min(seg_idx) AS first_idx FROM seg GROUP BY ALL")
def _(spark, d):
    return reports.speaker_totals(S.segments(spark, d))


@query("speaker_ordinals", f"WITH {_SEG}, a AS (SELECT meeting_id, gid, sum(n_words)::BIGINT AS words, min(seg_idx) AS f FROM seg GROUP BY ALL) SELECT meeting_id, gid, 'Speaker ' || row_number() OVER (PARTITION BY meeting_id ORDER BY words DESC, f) AS shown, words FROM a")
def _(spark, d):
    return reports.speaker_ordinals(S.segments(spark, d))


@query("dense_labels", f"WITH {_SEG}, a AS (SELECT meeting_id, gid, min(seg_idx) AS f FROM seg GROUP BY ALL) SELECT meeting_id, gid, dense_rank() OVER (PARTITION BY meeting_id ORDER BY f) - 1 AS k FROM a")
def _(spark, d):
    return reports.dense_labels(S.segments(spark, d))


@query("longest_turns", f"WITH {_SEG}, a AS (SELECT *, end_s - start_s AS dur FROM seg), b AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, gid ORDER BY dur DESC, seg_idx) AS k FROM a WHERE dur >= 1.5) SELECT meeting_id, gid, seg_idx, round(least(dur, 12.0), 3) AS clip_s FROM b WHERE k <= 3")
def _(spark, d):
    return reports.longest_turns(S.segments(spark, d))


@query("transcript_text", f"WITH {_SEG}, a AS (SELECT *, gid IS DISTINCT FROM lag(gid) OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS head FROM seg) SELECT meeting_id, string_agg(CASE WHEN head THEN chr(10) || gid || ':' || chr(10) ELSE '' END || text, chr(10) ORDER BY seg_idx) AS text FROM a GROUP BY meeting_id")
def _(spark, d):
    return reports.transcript(S.segments(spark, d))


@query("text_samples", f"WITH {_SEG}, a AS (SELECT meeting_id, gid, left(string_agg(text, ' ' ORDER BY seg_idx), 200) AS sample FROM seg GROUP BY ALL) SELECT * FROM a WHERE length(sample) > 60")
def _(spark, d):
    return reports.text_samples(S.segments(spark, d))


@query("coverage", f"WITH {_SEG}, e AS (SELECT meeting_id, max(end_s) + 5 AS speech_end FROM seg GROUP BY 1) SELECT meeting_id, round(coalesce(least(max(end_s) / greatest(speech_end, 1.0), 1.0), 0), 4) AS coverage FROM e LEFT JOIN (SELECT * FROM seg WHERE seg_idx > 0) USING (meeting_id) GROUP BY meeting_id, speech_end")
def _(spark, d):
    s = S.segments(spark, d)
    return assembly.coverage(s.filter("seg_idx > 0"), s.groupBy("meeting_id").agg((F.max("end_s") + 5).alias("speech_end")))


@query("confusion", f"WITH {_SEG} SELECT meeting_id, sum(n_words) FILTER (WHERE gid = 'G00')::BIGINT AS G00, sum(n_words) FILTER (WHERE gid = 'G01')::BIGINT AS G01, sum(n_words) FILTER (WHERE gid = 'G02')::BIGINT AS G02 FROM seg GROUP BY meeting_id")
def _(spark, d):
    return reports.confusion(S.segments(spark, d), ["G00", "G01", "G02"])


@query("repetition_guard", f"WITH {_LINES}, a AS (SELECT *, lower(trim(text, '{T.SPACES}')) AS k FROM line), b AS (SELECT *, sum(CASE WHEN k IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS run FROM (SELECT *, lag(k) OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS p FROM a)), r AS (SELECT *, count(*) OVER (PARTITION BY meeting_id, run) AS n, row_number() OVER (PARTITION BY meeting_id, run ORDER BY seg_idx) AS i FROM b) SELECT meeting_id, seg_idx::BIGINT AS seg_idx, text FROM r WHERE n < 4 OR i = 1")
def _(spark, d):
    return assembly.repetition_guard(S.lines(spark, d)).select("meeting_id", "seg_idx", "text")


@query(
    "seam_overlap",
    r"""WITH w AS (SELECT doc_id, string_split_regex(trim(text), '\s+') AS ws FROM documents), c AS (SELECT doc_id AS meeting_id, k AS win, ws[k * 20 + 1:k * 20 + 25] AS words FROM (SELECT *, unnest(range(0, greatest(((len(ws) - 6) // 20) + 1, 1))) AS k FROM w)),
f AS (SELECT meeting_id, win, list_transform(words, lambda x: lower(regexp_replace(x, '^[.,?!]+|[.,?!]+$', '', 'g'))) AS b FROM c), p AS (SELECT *, lag(b) OVER (PARTITION BY meeting_id ORDER BY win) AS a FROM f)
SELECT meeting_id, win, CASE WHEN a IS NULL THEN 0 ELSE coalesce(list_max(list_filter(range(3, 11), lambda n: n <= least(len(a), len(b) - 1) AND a[len(a) - n + 1:len(a)] = b[1:n])), 0) END::INT AS overlap FROM p""",
)
def _(spark, d):
    c = _chunks(S.table(spark, d, "documents"))
    return assembly.seams(c).select("meeting_id", "win", F.col("overlap").cast("int").alias("overlap"))


def _chunks(docs: DataFrame) -> DataFrame:
    """meeting_id, win, words: 25 words every 20. Each window's words are cut out before rows are made, so no row carries a whole text."""
    ws = docs.select(F.col("doc_id").cast("long").alias("meeting_id"), F.split(F.trim("text"), r"\s+").alias("ws"))
    cut = F.expr("transform(sequence(0, greatest(cast(floor((size(ws) - 6) / 20) AS int), 0)), k -> slice(ws, k * 20 + 1, 25))")
    return ws.select("meeting_id", F.posexplode(cut).alias("win", "words")).withColumn("win", F.col("win").cast("long"))


@query("scalar_text", r"""SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS folded, regexp_replace(s_name, '[^\p{L}\p{N}._-]', '_', 'g') AS safe, (s_suppkey * 37 // 3600) || ':' || lpad(((s_suppkey * 37 % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((s_suppkey * 37 % 60)::VARCHAR, 2, '0') AS hms, 'G' || lpad(s_suppkey::VARCHAR, greatest(2, length(s_suppkey::VARCHAR))::INT, '0') AS tag FROM supplier""")
def _(spark, d):
    s = S.table(spark, d, "supplier")
    return s.select("s_suppkey", T.fold(F.col("s_name")).alias("folded"), T.safe(F.col("s_name")).alias("safe"), T.hms(F.col("s_suppkey") * 37).alias("hms"), T.tagged(F.col("s_suppkey")).alias("tag"))


@query(
    "slug",
    r"""WITH a AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(string_split(text, chr(10))[1]), '[^\p{L}\p{N}\p{M}_\s-]+', ' ', 'g'), '[\s_-]+'), lambda x: x <> '')[1:5] AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, w, coalesce(w[1], 'meeting') AS s1 FROM a),
c AS (SELECT *, len(w) >= 2 AND length(s1 || '-' || w[2]) <= 40 AS g2 FROM b), e AS (SELECT *, CASE WHEN g2 THEN s1 || '-' || w[2] ELSE s1 END AS s2 FROM c),
f AS (SELECT *, g2 AND len(w) >= 3 AND length(s2 || '-' || w[3]) <= 40 AS g3 FROM e), g AS (SELECT *, CASE WHEN g3 THEN s2 || '-' || w[3] ELSE s2 END AS s3 FROM f),
h AS (SELECT *, g3 AND len(w) >= 4 AND length(s3 || '-' || w[4]) <= 40 AS g4 FROM g), i AS (SELECT *, CASE WHEN g4 THEN s3 || '-' || w[4] ELSE s3 END AS s4 FROM h)
SELECT doc_id, CASE WHEN g4 AND len(w) >= 5 AND length(s4 || '-' || w[5]) <= 40 THEN s4 || '-' || w[5] ELSE s4 END AS slug FROM i""",
)
def _(spark, d):
    return S.table(spark, d, "documents").filter("text is not null").select("doc_id", T.slug(F.split("text", "\n")[0]).alias("slug"))


# --- intervals ---


@query("other_speakers", f"WITH {_SPAN} SELECT a.meeting_id, a.seg_idx, b.seg_idx AS other_idx, round(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s), 3) AS seconds FROM span a JOIN span b ON a.meeting_id = b.meeting_id AND a.local_label <> b.local_label AND a.start_s < b.end_s AND b.start_s < a.end_s")
def _(spark, d):
    return assembly.other_speakers(S.intervals(spark, d)).withColumn("seconds", F.round("seconds", 3))


@query("orphan_cover", f"WITH {_SPAN}, j AS (SELECT a.meeting_id, a.seg_idx, a.end_s - a.start_s AS dur, least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s) AS s FROM span a JOIN span b ON a.meeting_id = b.meeting_id AND a.local_label <> b.local_label AND a.start_s < b.end_s AND b.start_s < a.end_s) SELECT meeting_id, seg_idx, count(*) AS touched, round(sum(s), 3) AS covered, sum(s) >= 0.5 * max(dur) AS enough FROM j GROUP BY ALL")
def _(spark, d):
    j = assembly.speaker_overlaps(S.intervals(spark, d))
    return j.groupBy("meeting_id", "seg_idx").agg(F.count("*").alias("touched"), F.round(F.sum("seconds"), 3).alias("covered"), (F.sum("seconds") >= DEFAULTS.covered_enough * F.max("dur")).alias("enough"))


@query("speaker_seconds", f"WITH {_SPAN} SELECT a.meeting_id, a.local_label, b.local_label AS reference, round(sum(least(a.end_s, b.end_s) - greatest(a.start_s, b.start_s)), 2) AS seconds FROM span a JOIN span b ON a.meeting_id = b.meeting_id AND a.local_label <> b.local_label AND a.start_s < b.end_s AND b.start_s < a.end_s GROUP BY ALL")
def _(spark, d):
    j = assembly.speaker_overlaps(S.intervals(spark, d))
    return j.groupBy("meeting_id", "local_label", "reference").agg(F.round(F.sum("seconds"), 2).alias("seconds"))


@query("turns", f"WITH {_SPAN}, a AS (SELECT *, sum(CASE WHEN local_label IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id ORDER BY start_s, seg_idx) AS turn FROM (SELECT *, lag(local_label) OVER (PARTITION BY meeting_id ORDER BY start_s, seg_idx) AS p FROM span)) SELECT meeting_id, turn::BIGINT AS turn, local_label, round(min(start_s), 3) AS start_s, round(max(end_s), 3) AS end_s, count(*) AS n FROM a GROUP BY meeting_id, turn, local_label")
def _(spark, d):
    return assembly.turns(S.intervals(spark, d)).withColumn("start_s", F.round("start_s", 3)).withColumn("end_s", F.round("end_s", 3))


@query("free_gaps", f"WITH {_SPAN} SELECT meeting_id, seg_idx, round(greatest(start_s - max(end_s) OVER (PARTITION BY meeting_id ORDER BY start_s, seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 3) AS gap_s FROM span")
def _(spark, d):
    return assembly.free_run(S.intervals(spark, d)).withColumn("gap_s", F.round("gap_s", 3))


@query("embed_spans", f"WITH {_SPAN}, a AS (SELECT *, start_s + 0.2::DOUBLE AS a, end_s - 0.2::DOUBLE AS b FROM span), c AS (SELECT *, CASE WHEN b - a > 20 THEN (a + b) / 2 - 10 ELSE a END AS f, CASE WHEN b - a > 20 THEN (a + b) / 2 + 10 ELSE b END AS t FROM a) SELECT meeting_id, seg_idx, round(f, 3) AS from_s, round(t, 3) AS to_s FROM c WHERE t - f >= 0.5")
def _(spark, d):
    return assembly.embed_spans(S.intervals(spark, d)).select("meeting_id", "seg_idx", F.round("from_s", 3).alias("from_s"), F.round("to_s", 3).alias("to_s"))


@query("hop_windows", f"WITH {_SPAN}, a AS (SELECT *, unnest(range(greatest(floor((start_s - 7200) / 3600) + 1, 0)::BIGINT, floor(start_s / 3600)::BIGINT + 1)) AS k FROM span) SELECT meeting_id, k, count(*) AS n FROM a GROUP BY ALL")
def _(spark, d):
    return assembly.windows_of(S.intervals(spark, d), 7200.0, 3600.0).groupBy("meeting_id", "k").agg(F.count("*").alias("n"))


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    return windows.tumbling(S.table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("hopping_counts", "WITH a AS (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - unnest(range(0, 3)) * INTERVAL 10 MINUTE AS start FROM events) SELECT start, count(*) AS n FROM a GROUP BY ALL")
def _(spark, d):
    return windows.hopping(S.table(spark, d, "events"))


@query("session_counts", 'WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS n FROM b GROUP BY user_id, s')
def _(spark, d):
    return windows.sessions(S.table(spark, d, "events"))


@query("channel_vote", "WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, sum(n) OVER (PARTITION BY user_id) AS al FROM a), m AS (SELECT user_id, event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY ALL) SELECT user_id, event_type AS kind, round(n / al, 6) AS agreement, round(m, 6) AS median_value FROM b JOIN m USING (user_id, event_type) WHERE k = 1")
def _(spark, d):
    return reports.channel_vote(S.table(spark, d, "events"))


# --- voices ---


@query("named_share", f"WITH {_ATOM}, b AS (SELECT meeting_id, vec_id, sec, max(sim) AS s FROM score GROUP BY ALL) SELECT meeting_id, count(*) AS n_atoms, round(sum(CASE WHEN s >= 0.62 THEN sec ELSE 0 END) / sum(sec), 4) AS named_share FROM b GROUP BY meeting_id")
def _(spark, d):
    return matching.named_share(matching.scores(S.atoms(spark, d), S.bank(spark, d)))


@query("voice_margins", f"WITH {_ATOM}, a AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, person) AS k, lead(sim) OVER (PARTITION BY vec_id ORDER BY sim DESC, person) AS nx FROM score) SELECT vec_id, person, round(sim, 6) AS sim, round(sim - nx, 6) AS margin FROM a WHERE k = 1")
def _(spark, d):
    m = matching.margins(matching.scores(S.atoms(spark, d), S.bank(spark, d)))
    return m.withColumn("sim", F.round("sim", 6)).withColumn("margin", F.round("margin", 6))


@query("suggested_people", f"WITH {_ATOM}, a AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, person) AS rank FROM score) SELECT vec_id, rank::INT AS rank, person, round(sim, 6) AS sim FROM a WHERE rank <= 4")
def _(spark, d):
    return matching.top_people(matching.scores(S.atoms(spark, d), S.bank(spark, d))).select("vec_id", F.col("rank").cast("int").alias("rank"), "person", F.round("sim", 6).alias("sim"))


_POOLED = f"WITH {_ATOM}, e AS (SELECT meeting_id, label, i, sum(v[i] * w) / sum(w) AS x FROM (SELECT meeting_id, label, v, WEIGHT AS w, unnest(range(1, 65)) AS i FROM atom) GROUP BY ALL), n AS (SELECT meeting_id, label, sqrt(sum(x * x)) AS nrm FROM e GROUP BY ALL) SELECT meeting_id, label, i::INT - 1 AS i, round(x / nrm, 5) + 0.0 AS x FROM e JOIN n USING (meeting_id, label)"


def _flat(p: DataFrame) -> DataFrame:
    return p.select("meeting_id", "label", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 5) + 0.0)


@query("pooled_atoms", _POOLED.replace("WEIGHT", "1"))
def _(spark, d):
    return _flat(matching.pool(S.atoms(spark, d), "meeting_id", "label"))


@query("weighted_centroids", _POOLED.replace("WEIGHT", "sec"))
def _(spark, d):
    return _flat(matching.pool(S.atoms(spark, d), "meeting_id", "label", weight="sec"))


_PAIRS = "pair AS (SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN a.label = b.label THEN 0.65 ELSE 0 END::DOUBLE + 0.35::DOUBLE * list_inner_product(a.v, b.v) AS sim FROM atom a JOIN atom b ON a.vec_id < b.vec_id)"


def _vectors(spark, d):
    return S.atoms(spark, d).select(F.col("vec_id").alias("id"), "label", "v")


@query("similar_pairs", f"WITH {_ATOM}, {_PAIRS} SELECT a, b, round(sim, 6) AS sim FROM pair WHERE sim >= 0.72")
def _(spark, d):
    return linking.similar_pairs(_vectors(spark, d), DEFAULTS.keep_exemplar).withColumn("sim", F.round("sim", 6))


@query("linked_groups", f"WITH RECURSIVE {_ATOM}, {_PAIRS}, e AS (SELECT a, b FROM pair WHERE sim >= 0.75 UNION SELECT b, a FROM pair WHERE sim >= 0.75), r AS (SELECT a AS node, a AS cur FROM e UNION SELECT r.node, e.b AS cur FROM r JOIN e ON r.cur = e.a) SELECT node, min(cur) AS label FROM r GROUP BY node")
def _(spark, d):
    return linking.similar_groups(_vectors(spark, d), DEFAULTS.link_accept)


@query("weakest_link", f"WITH {_ATOM}, {_PAIRS} SELECT count(*) AS n, round(min(sim), 6) AS weakest FROM pair WHERE sim >= 0.75")
def _(spark, d):
    return linking.similar_pairs(_vectors(spark, d), DEFAULTS.link_accept).agg(F.count("*").alias("n"), F.round(F.min("sim"), 6).alias("weakest"))


@query("corroboration", f"WITH {_ATOM}, {_PAIRS}, e AS (SELECT a, b FROM pair WHERE sim >= 0.72 UNION ALL SELECT b, a FROM pair WHERE sim >= 0.72) SELECT a AS vec_id, count(*) AS agreeing FROM e GROUP BY a HAVING count(*) >= 3")
def _(spark, d):
    p = linking.similar_pairs(_vectors(spark, d), DEFAULTS.keep_exemplar)
    e = p.select(F.explode(F.array("a", "b")).alias("vec_id"))
    return e.groupBy("vec_id").agg(F.count("*").alias("agreeing")).filter(F.col("agreeing") >= DEFAULTS.min_corroboration - 1)


@query("cannot_link", f"WITH {_ATOM}, w AS (SELECT meeting_id, win FROM atom GROUP BY ALL HAVING count(DISTINCT local_label) <= 10), x AS (SELECT * FROM atom JOIN w USING (meeting_id, win) WHERE sec >= 6) SELECT x.meeting_id, x.win, x.vec_id AS a, y.vec_id AS b FROM x JOIN x y ON x.meeting_id = y.meeting_id AND x.win = y.win AND x.vec_id < y.vec_id AND x.local_label <> y.local_label")
def _(spark, d):
    return linking.cannot_link(S.atoms(spark, d), DEFAULTS.durable_s, DEFAULTS.guard)


@query("cluster_cannot_link", f"WITH {_ATOM}, w AS (SELECT meeting_id, win FROM atom GROUP BY ALL HAVING count(DISTINCT local_label) <= 10), x AS (SELECT * FROM atom JOIN w USING (meeting_id, win) WHERE sec >= 6) SELECT DISTINCT x.meeting_id, least(x.label, y.label)::BIGINT AS ca, greatest(x.label, y.label)::BIGINT AS cb FROM x JOIN x y ON x.meeting_id = y.meeting_id AND x.win = y.win AND x.vec_id < y.vec_id AND x.local_label <> y.local_label WHERE x.label <> y.label AND x.label > 0 AND y.label > 0")
def _(spark, d):
    a = S.atoms(spark, d)
    labelled = a.select("meeting_id", "vec_id", F.when(F.col("label") > 0, F.col("label")).otherwise(-1).cast("long").alias("cluster"))
    return linking.lifted(linking.cannot_link(a, DEFAULTS.durable_s, DEFAULTS.guard), labelled)


@query("min_k", f"WITH {_ATOM}, k AS (SELECT meeting_id, win, count(DISTINCT local_label) AS k FROM atom WHERE sec >= 6 GROUP BY ALL HAVING count(DISTINCT local_label) <= 10) SELECT meeting_id, coalesce(max(k), 1) AS min_k FROM (SELECT DISTINCT meeting_id FROM atom) LEFT JOIN k USING (meeting_id) GROUP BY meeting_id")
def _(spark, d):
    return linking.min_k(S.atoms(spark, d), DEFAULTS.durable_s, DEFAULTS.guard)


@query("core_set", f"WITH {_ATOM}, a AS (SELECT *, max(CASE WHEN sec >= 50 THEN 1 ELSE 0 END) OVER w AS p, max(CASE WHEN sec > 0 THEN 1 ELSE 0 END) OVER w AS q, row_number() OVER (PARTITION BY meeting_id, win ORDER BY sec DESC, vec_id) AS k FROM atom WINDOW w AS (PARTITION BY meeting_id, win)) SELECT meeting_id, win, vec_id FROM a WHERE CASE WHEN p = 1 THEN sec >= 50 WHEN q = 1 THEN sec > 0 ELSE k = 1 END")
def _(spark, d):
    return linking.core_set(S.atoms(spark, d), 50.0, "meeting_id", "win").select("meeting_id", "win", "vec_id")


@query("nearest_centre", f"WITH {_ATOM}, s AS (SELECT atom.vec_id, c.vec_id AS centre, CASE WHEN atom.label = c.label THEN 0.65 ELSE 0 END::DOUBLE + 0.35::DOUBLE * list_inner_product(atom.v, c.v) AS sim FROM atom, atom c WHERE c.vec_id < 12) SELECT vec_id, centre, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, centre) AS k FROM s) WHERE k = 1")
def _(spark, d):
    a = S.atoms(spark, d)
    c = a.filter("vec_id < 12").select(F.col("vec_id").alias("centre"), F.col("label").alias("clabel"), F.col("v").alias("cv"))
    return matching.nearest(a, c).withColumn("sim", F.round("sim", 6))


@query("window_assignment", f"WITH RECURSIVE {_ATOM}, s AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, win ORDER BY sim DESC, vec_id, person) AS k FROM score WHERE sim >= 0.62), r AS (SELECT DISTINCT meeting_id, win, 0::BIGINT AS k, []::BIGINT[] AS a, []::BIGINT[] AS p FROM s UNION ALL SELECT r.meeting_id, r.win, s.k, CASE WHEN list_contains(a, vec_id) OR list_contains(p, person) THEN a ELSE list_append(a, vec_id) END, CASE WHEN list_contains(a, vec_id) OR list_contains(p, person) THEN p ELSE list_append(p, person) END FROM r JOIN s ON s.meeting_id = r.meeting_id AND s.win = r.win AND s.k = r.k + 1), e AS (SELECT meeting_id, unnest(arg_max(a, k)) AS vec_id, unnest(arg_max(p, k)) AS person FROM r GROUP BY meeting_id, win) SELECT e.meeting_id, e.vec_id, e.person::INT AS person, round(sim, 6) AS sim FROM e JOIN score ON score.vec_id = e.vec_id AND score.person = e.person")
def _(spark, d):
    return matching.one_to_one(matching.scores(S.atoms(spark, d), S.bank(spark, d))).withColumn("sim", F.round("sim", 6))


@query("meeting_clusters")
def _(spark, d):
    return clustering.cluster_meetings(S.atoms(spark, d))


@query("linkage_merges")
def _(spark, d):
    return clustering.merge_steps(S.atoms(spark, d))


# every parted pair must end up in two clusters, so the pairs themselves are what is left of them
@query("parted_pairs", f"WITH {_ATOM}, w AS (SELECT meeting_id, win FROM atom WHERE sec >= 2 GROUP BY ALL HAVING count(DISTINCT local_label) <= 10), x AS (SELECT * FROM atom JOIN w USING (meeting_id, win) WHERE sec >= 6) SELECT x.meeting_id, x.vec_id AS a, y.vec_id AS b FROM x JOIN x y ON x.meeting_id = y.meeting_id AND x.win = y.win AND x.vec_id < y.vec_id AND x.local_label <> y.local_label")
def _(spark, d):
    a = S.atoms(spark, d)
    apart = linking.cannot_link(a.filter(F.col("sec") >= DEFAULTS.min_core), DEFAULTS.durable_s, DEFAULTS.guard).select("meeting_id", "a", "b")
    return apart.join(clustering.violations(clustering.cluster_meetings(a), apart), ["meeting_id", "a", "b"], "left_anti")


@query("covering_sets")
def _(spark, d):
    return clustering.covering_sets(S.atoms(spark, d), "label")


# --- store and reports ---


@query("review_queue", f"WITH {_ATOM}, {_STORE} SELECT group_id, count(*) AS n_clusters, count(DISTINCT meeting_id) AS meetings, sum(seconds) AS seconds FROM clu JOIN grp USING (group_id) WHERE speaker_id IS NULL GROUP BY group_id HAVING sum(seconds) >= 60 ORDER BY meetings DESC, seconds DESC, group_id LIMIT 15")
def _(spark, d):
    return reports.review_queue(S.clusters(spark, d), S.groups(spark, d))


@query("group_report", f"WITH {_ATOM}, {_STORE} SELECT group_id, name, count(cluster) AS n_clusters, count(DISTINCT meeting_id) AS meetings, coalesce(sum(seconds), 0) AS seconds FROM grp LEFT JOIN clu USING (group_id) LEFT JOIN spk ON speaker_id = id GROUP BY group_id, name")
def _(spark, d):
    return reports.group_report(S.groups(spark, d), S.clusters(spark, d), S.speakers(spark, d))


@query("speaker_list", f"WITH {_ATOM}, {_STORE} SELECT id, name, count(condition) AS conditions, coalesce(sum(seconds), 0) AS seconds FROM spk LEFT JOIN exe ON speaker_id = id GROUP BY id, name")
def _(spark, d):
    return reports.speaker_list(S.speakers(spark, d), S.exemplars(spark, d))


@query("named_bank", f"WITH {_ATOM}, {_STORE} SELECT name, condition, seconds, list_transform(v, lambda x: round(x, 6) + 0.0) AS v FROM exe JOIN spk ON speaker_id = id WHERE name <> 'Speaker_4'")
def _(spark, d):
    s = S.speakers(spark, d).filter("name <> 'Speaker_4'")
    e = S.exemplars(spark, d)
    return e.join(s, e["speaker_id"] == s["id"]).select("name", "condition", "seconds", F.transform("v", lambda x: F.round(x, 6) + 0.0).alias("v"))


@query("inherited_names", f"WITH {_ATOM}, {_STORE}, a AS (SELECT meeting_id, speaker_id, sum(seconds) AS s FROM clu JOIN grp USING (group_id) GROUP BY ALL), b AS (SELECT *, s / sum(s) OVER (PARTITION BY meeting_id) AS share FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY s DESC, speaker_id DESC) AS k FROM b WHERE speaker_id IS NOT NULL) SELECT meeting_id, speaker_id, round(share, 6) AS share FROM c WHERE k = 1 AND share >= 0.15")
def _(spark, d):
    return reports.inherited_names(S.clusters(spark, d), S.groups(spark, d), 0.15)


@query("names_from_groups", f"WITH {_ATOM}, {_STORE} SELECT meeting_id, cluster, name FROM clu JOIN grp USING (group_id) JOIN spk ON speaker_id = id")
def _(spark, d):
    g = S.groups(spark, d).join(S.speakers(spark, d).withColumnRenamed("id", "speaker_id"), "speaker_id")
    return S.clusters(spark, d).join(g, "group_id").select("meeting_id", "cluster", "name")


@query("weak_suspects", f"WITH {_ATOM}, {_STORE}, f AS (SELECT vec_id, label, sec, max(sim) AS fit FROM score WHERE person = label GROUP BY ALL) SELECT vec_id, label, round(fit, 6) AS fit FROM f WHERE fit < 0.62 AND sec >= 10 ORDER BY fit, vec_id LIMIT 10")
def _(spark, d):
    s = matching.scores(S.atoms(spark, d), S.bank(spark, d)).filter("person = label")
    f = s.groupBy("vec_id", "label", "sec").agg(F.max("sim").alias("fit")).filter((F.col("fit") < 0.62) & (F.col("sec") >= DEFAULTS.min_enroll_sec))
    return f.orderBy("fit", "vec_id").limit(10).select("vec_id", "label", F.round("fit", 6).alias("fit"))


@query("cluster_stats", f"WITH {_ATOM}, {_STORE} SELECT meeting_id, count(*) AS n, count(*) FILTER (WHERE seconds >= 60) AS linkable, median(seconds) AS median_s, sum(seconds) AS total_s FROM clu GROUP BY meeting_id")
def _(spark, d):
    return S.clusters(spark, d).groupBy("meeting_id").agg(F.count("*").alias("n"), F.count_if(F.col("seconds") >= DEFAULTS.min_link_sec).alias("linkable"), F.median("seconds").alias("median_s"), F.sum("seconds").alias("total_s"))


@query("height_gaps", f"WITH {_ATOM}, {_STORE}, a AS (SELECT meeting_id, seconds, lead(seconds) OVER (PARTITION BY meeting_id ORDER BY seconds, group_id) - seconds AS gap FROM clu), b AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY gap DESC, seconds) AS k FROM a WHERE gap IS NOT NULL) SELECT meeting_id, seconds AS at, gap FROM b WHERE k = 1")
def _(spark, d):
    from pyspark.sql import Window

    a = S.clusters(spark, d).withColumn("gap", F.lead("seconds").over(Window.partitionBy("meeting_id").orderBy("seconds", "group_id")) - F.col("seconds")).filter("gap is not null")
    b = a.withColumn("k", F.row_number().over(Window.partitionBy("meeting_id").orderBy(F.desc("gap"), "seconds")))
    return b.filter("k = 1").select("meeting_id", F.col("seconds").alias("at"), "gap")


def _store(spark, d) -> store.Store:
    return store.Store(S.speakers(spark, d), S.groups(spark, d), S.clusters(spark, d), S.exemplars(spark, d))


@query("forget_speaker", f"WITH {_ATOM}, {_STORE} SELECT group_id, CASE WHEN speaker_id = 4 THEN NULL ELSE speaker_id END AS speaker_id, (SELECT count(*) FROM exe WHERE exe.speaker_id = grp.speaker_id AND exe.speaker_id <> 4) AS exemplars FROM grp")
def _(spark, d):
    s = store.forget_speaker(_store(spark, d), 4)
    n = s.exemplars.groupBy("speaker_id").agg(F.count("*").alias("exemplars"))
    return s.groups.join(n, "speaker_id", "left").select("group_id", "speaker_id", F.coalesce("exemplars", F.lit(0)).cast("long").alias("exemplars"))


@query("insert_speakers", f"WITH {_ATOM}, {_STORE}, n AS (SELECT 100 + label::BIGINT AS id, 'Speaker_' || label AS name FROM (SELECT DISTINCT label FROM embeddings)) SELECT * FROM spk UNION ALL SELECT * FROM n WHERE name NOT IN (SELECT name FROM spk)")
def _(spark, d):
    new = S.table(spark, d, "embeddings").select("label").distinct().select((100 + F.col("label")).cast("long").alias("id"), F.concat(F.lit("Speaker_"), F.col("label").cast("string")).alias("name"))
    return store.insert_speakers(_store(spark, d), new).speakers


# two meetings in five are decoded anew; the others stay in the store as they are
@query("upsert_clusters", f"WITH {_ATOM}, {_STORE}, n AS (SELECT meeting_id, 'G0' || label AS cluster, sum(sec) AS seconds, count(*) AS n_atoms FROM atom WHERE win <> 1 AND meeting_id % 5 < 2 GROUP BY ALL) SELECT n.meeting_id, n.cluster, n.seconds, CASE WHEN n.n_atoms = o.n_atoms THEN o.group_id END AS group_id FROM n LEFT JOIN clu o ON n.meeting_id = o.meeting_id AND n.cluster = o.cluster UNION ALL SELECT meeting_id, cluster, seconds, group_id FROM clu WHERE meeting_id % 5 >= 2")
def _(spark, d):
    new = S.atoms(spark, d).filter("win <> 1 and meeting_id % 5 < 2").groupBy("meeting_id", F.concat(F.lit("G0"), F.col("label").cast("string")).alias("cluster")).agg(F.sum("sec").alias("seconds"), F.count("*").alias("digest"))
    old = S.clusters(spark, d).select("meeting_id", "cluster", "seconds", F.col("n_atoms").alias("digest"), "group_id")
    return store.upsert_clusters(old, new).select("meeting_id", "cluster", "seconds", "group_id")


@query("pooled_exemplars", f"WITH {_ATOM}, {_STORE}, b AS (SELECT speaker_id, condition, v, seconds FROM exe UNION ALL SELECT speaker_id, condition, list_reverse(v), 10.0 FROM exe WHERE condition = 'room'), e AS (SELECT speaker_id, condition, i, sum(v[i] * seconds) / sum(seconds) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM b) GROUP BY ALL), n AS (SELECT speaker_id, condition, sqrt(sum(x * x)) AS nrm FROM e GROUP BY ALL) SELECT e.speaker_id, e.condition, list(round(x / nrm, 5) + 0.0 ORDER BY i) AS v, any_value(s) AS seconds FROM e JOIN n USING (speaker_id, condition) JOIN (SELECT speaker_id, condition, sum(seconds) AS s FROM b GROUP BY ALL) USING (speaker_id, condition) GROUP BY ALL")
def _(spark, d):
    e = S.exemplars(spark, d)
    new = e.filter("condition = 'room'").select("speaker_id", "condition", F.reverse("v").alias("v"), F.lit(10.0).alias("seconds"))
    return store.pool_exemplars(e, new).select("speaker_id", "condition", F.transform("v", lambda x: F.round(x, 5) + 0.0).alias("v"), "seconds")


@query("store_integrity", "SELECT unnest(['groups.speaker', 'exemplars.speaker', 'clusters.group', 'speakers.name', 'clusters.key', 'exemplars.key']) AS problem, 0::BIGINT AS n")
def _(spark, d):
    return store.integrity(_store(spark, d))


def _linkable(spark, d):
    a = S.atoms(spark, d)
    c = S.clusters(spark, d).select("meeting_id", F.col("group_id").alias("label"), "seconds")
    v = matching.pool(a.withColumn("label", F.col("label").cast("long")), "meeting_id", "label", weight="sec")
    # labels 0 and 2 are named in the first five meetings, the bank knows 0, 2 and 4
    named = F.when(F.col("label").isin(0, 2) & (F.col("meeting_id") < 5), F.col("label")).alias("speaker_id")
    return c.join(v, ["meeting_id", "label"]).select((F.col("meeting_id") * 100 + F.col("label")).alias("id"), "meeting_id", "label", "v", "seconds", named), S.bank(spark, d, 2).filter("person in (0, 2, 4)")


@query("identity_groups")
def _(spark, d):
    return identity.link_groups(*_linkable(spark, d)).select("id", "meeting_id", "grp", "speaker_id", "how")


@query("identities_per_meeting", f"WITH {_ATOM}, {_STORE} SELECT meeting_id, count(*) AS n_clusters, count(*) AS n_identities FROM clu WHERE seconds >= 60 GROUP BY meeting_id")
def _(spark, d):
    g = identity.link_groups(*_linkable(spark, d))
    return g.groupBy("meeting_id").agg(F.count("*").alias("n_clusters"), F.count_distinct("grp").alias("n_identities"))


@query("near_names", "WITH b AS (SELECT DISTINCT s_name AS n, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS f FROM supplier), a AS (SELECT n2 AS n, regexp_replace(lower(n2), '[^a-z0-9]+', '', 'g') AS f FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN replace(s_name, '#', ' ') ELSE s_name END AS n2 FROM supplier) WHERE n2 NOT IN (SELECT n FROM b)) SELECT DISTINCT x.n AS a_name, y.n AS b_name FROM a x JOIN b y ON x.f <> '' AND y.f <> '' AND levenshtein(x.f, y.f) <= 1")
def _(spark, d):
    s = S.table(spark, d, "supplier")
    new = s.select(F.when(F.col("s_suppkey") % 2 == 0, F.replace("s_name", F.lit("#"), F.lit(" "))).otherwise(F.col("s_name")).alias("name"))
    return store.near_names(new, s.select(F.col("s_name").alias("name")), 1)


_LABELLED = "SELECT doc_id, source FROM documents WHERE doc_id {} IN (SELECT doc_id FROM labels)"


@query("unlabelled_meetings", _LABELLED.format("NOT"))
def _(spark, d):
    return S.table(spark, d, "documents").join(S.table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("labelled_meetings", _LABELLED.format(""))
def _(spark, d):
    return S.table(spark, d, "documents").join(S.table(spark, d, "labels"), "doc_id", "left_semi").select("doc_id", "source")


@query("manifest_lookup", "WITH f AS (SELECT doc_id, source || '/' || doc_id AS name, source AS stem FROM documents), m AS (SELECT 'src' || (doc_id % 20) || '/' || doc_id AS key, CASE WHEN quality = 1 THEN 'good' ELSE '' END AS glossary FROM labels UNION ALL SELECT 'src3', 'stem') SELECT f.name, coalesce(nullif(a.glossary, ''), nullif(b.glossary, ''), 'none') AS glossary FROM f LEFT JOIN m a ON a.key = f.name LEFT JOIN m b ON b.key = f.stem")
def _(spark, d):
    f = S.table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("stem"))
    m = S.table(spark, d, "labels").select(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"), F.lit("/"), F.col("doc_id").cast("string")).alias("key"), F.when(F.col("quality") == 1, "good").otherwise("").alias("glossary"))
    return reports.manifest_lookup(f, m.unionByName(spark.createDataFrame([("src3", "stem")], "key string, glossary string")), "none")


@query("name_diff", "WITH b AS (SELECT doc_id AS key, quality AS name FROM labels WHERE doc_id % 3 <> 0), a AS (SELECT doc_id AS key, toxic AS name FROM labels WHERE doc_id % 3 <> 1) SELECT key, CASE WHEN b.name IS NULL THEN 'gained' WHEN a.name IS NULL THEN 'lost' ELSE 'changed' END AS change FROM b FULL JOIN a USING (key) WHERE b.name IS DISTINCT FROM a.name")
def _(spark, d):
    x = S.table(spark, d, "labels")
    return reports.name_diff(x.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("key"), F.col("quality").alias("name")), x.filter("doc_id % 3 <> 1").select(F.col("doc_id").alias("key"), F.col("toxic").alias("name")))


# --- selection ---


@query("roster_bank", f"WITH {_ATOM} SELECT label AS person, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM atom) WHERE k <= 2 AND label % 3 = 0")
def _(spark, d):
    roster = S.table(spark, d, "embeddings").filter("label % 3 = 0").select(F.col("label").alias("person"))
    return selection.in_roster(S.bank(spark, d, 2), roster, "person").select("person", "vec_id")


@query("channel_hints", "WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k, sum(n) OVER (PARTITION BY user_id) AS al FROM a) SELECT 'auto-' || user_id AS name, event_type AS kind, round(n / al, 6) AS share FROM b WHERE k = 1 AND user_id % 2 = 0 AND n / al >= 0.23 AND event_type = 'click'")
def _(spark, d):
    v = reports.channel_vote(S.table(spark, d, "events"))
    name = F.concat(F.when(F.col("user_id") % 2 == 0, "auto-").otherwise("person-"), F.col("user_id").cast("string"))
    return selection.channel_hint(v.select(name.alias("name"), "kind", F.col("agreement").alias("share")), "click", 0.23)


@query("capped_windows", f"WITH {_SEG} SELECT meeting_id, array_to_string(list_sort(list(DISTINCT win)), ',') AS windows FROM seg WHERE n_words > 20 GROUP BY meeting_id")
def _(spark, d):
    g = S.segments(spark, d).withColumn("finish_reason", F.when(F.col("n_words") > 20, "length").otherwise("stop"))
    return selection.capped_windows(g).select("meeting_id", F.array_join(F.col("windows").cast("array<string>"), ",").alias("windows"))


@query("recording_paths", "SELECT page_id, url AS path FROM pages")
def _(spark, d):
    return S.table(spark, d, "pages").select("page_id", selection.refuse_clips(F.col("url")).alias("path"))


@query("labelled_segments", f"WITH {_SEG} SELECT meeting_id, seg_idx, CASE WHEN win % 2 = 0 THEN gid END AS label FROM seg")
def _(spark, d):
    s = S.segments(spark, d)
    labels = s.filter("win % 2 = 0").groupBy("meeting_id", "win", "local_label").agg(F.first("gid").alias("label"), F.count("*").alias("n_segments"))
    return selection.labels_to_segments(s, labels).select("meeting_id", "seg_idx", "label")


_SEGVEC = f"{_SEG}, vec AS (SELECT meeting_id, seg_idx, n_words * 0.4::DOUBLE AS dur_used, [n_words, seg_idx + 1]::DOUBLE[] AS v FROM seg WHERE seg_idx % 2 = 1)"


def _segment_vectors(spark, d):
    s = S.segments(spark, d)
    return s, s.filter("seg_idx % 2 = 1").select("meeting_id", "seg_idx", (F.col("n_words") * 0.4).alias("dur_used"), F.array(F.col("n_words").cast("double"), (F.col("seg_idx") + 1).cast("double")).alias("v"))


@query("segment_vectors", f"WITH {_SEGVEC} SELECT meeting_id, seg_idx, gid, round(dur_used, 3) AS dur_used, v FROM seg JOIN vec USING (meeting_id, seg_idx)")
def _(spark, d):
    return selection.vectors_to_segments(*_segment_vectors(spark, d)).select("meeting_id", "seg_idx", "gid", F.round("dur_used", 3).alias("dur_used"), "v")


@query("pooled_keys", f"WITH {_SEGVEC}, a AS (SELECT meeting_id, win, local_label, sum(dur_used) AS s, count(dur_used) AS n, avg(v[1]) AS x, avg(v[2]) AS y FROM seg LEFT JOIN vec USING (meeting_id, seg_idx) GROUP BY ALL) SELECT meeting_id, win, local_label, round(coalesce(s, 0), 3) AS seconds, n, round(coalesce(x / sqrt(x * x + y * y), 0), 5) AS v0, round(coalesce(y / sqrt(x * x + y * y), 0), 5) AS v1 FROM a")
def _(spark, d):
    return selection.pool_all(*_segment_vectors(spark, d), "meeting_id", "win", "local_label").select("meeting_id", "win", "local_label", F.round("seconds", 3).alias("seconds"), "n", F.round(F.col("v")[0], 5).alias("v0"), F.round(F.col("v")[1], 5).alias("v1"))


_LEVEL = "lv AS (SELECT user_id AS meeting_id, frame, greatest(10 * log10(greatest(avg(value * value), 1e-12)), -120.0) AS db FROM (SELECT *, floor(event_id / 50)::BIGINT AS frame FROM events) GROUP BY ALL)"


def _levels(spark, d):
    return selection.frame_levels(S.table(spark, d, "events").select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("i"), F.col("value").cast("double").alias("x")), 50)


@query("frame_levels", f"WITH {_LEVEL} SELECT meeting_id, frame, round(db, 5) AS db FROM lv")
def _(spark, d):
    return _levels(spark, d).withColumn("db", F.round("db", 5))


@query("speech_ends", f"WITH {_LEVEL} SELECT meeting_id, round(coalesce(max(frame) FILTER (WHERE db >= 40) * 0.01::DOUBLE, (max(frame) + 1) * 0.01::DOUBLE), 3) AS speech_end FROM lv GROUP BY meeting_id")
def _(spark, d):
    return selection.speech_end(_levels(spark, d), silence_db=40.0).withColumn("speech_end", F.round("speech_end", 3))


@query("busy_shares", "SELECT event_type AS phase, round(sum(value), 3) AS busy_s, round(sum(value) / sum(sum(value)) OVER (), 6) AS share FROM events GROUP BY event_type")
def _(spark, d):
    p = S.table(spark, d, "events").select(F.col("user_id").alias("meeting_id"), F.col("event_type").alias("phase"), F.col("value").alias("seconds"))
    return selection.busy_shares(p).select("phase", F.round("busy_s", 3).alias("busy_s"), F.round("share", 6).alias("share"))


@query("top_segments", f"WITH {_SEG} SELECT meeting_id, seg_idx FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, win, local_label ORDER BY n_words DESC, seg_idx) AS k FROM seg) WHERE k <= 2")
def _(spark, d):
    return selection.top_segments(S.segments(spark, d).withColumn("dur", F.col("n_words")), 2).select("meeting_id", "seg_idx")


@query("next_auto_index", 'SELECT max(s_suppkey) + 1 AS "next" FROM supplier WHERE s_suppkey % 2 = 0')
def _(spark, d):
    s = S.table(spark, d, "supplier")
    return selection.next_auto_index(s.select(F.concat(F.when(F.col("s_suppkey") % 2 == 0, "auto-").otherwise("person-"), F.col("s_suppkey").cast("string")).alias("name")))


@query("weak_atoms", f"WITH {_ATOM}, a AS (SELECT *, max(CASE WHEN sec >= 20 THEN 1 ELSE 0 END) OVER w AS p, row_number() OVER (PARTITION BY meeting_id, win ORDER BY sec DESC, vec_id) AS k, max(CASE WHEN sec > 0 THEN 1 ELSE 0 END) OVER w AS q FROM atom WINDOW w AS (PARTITION BY meeting_id, win)) SELECT vec_id FROM a WHERE sec < 20 AND NOT CASE WHEN p = 1 THEN sec >= 20 WHEN q = 1 THEN sec > 0 ELSE k = 1 END")
def _(spark, d):
    a = S.atoms(spark, d)
    return selection.weak_atoms(a, linking.core_set(a, 20.0, "meeting_id", "win"), 20.0).select("vec_id")


@query("sql_functions", "WITH a AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(list_inner_product(v, v), 5) AS square, round(v[1] / sqrt(list_inner_product(v, v)), 5) AS v0, (vec_id // 3600) || ':' || lpad((vec_id % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((vec_id % 60)::VARCHAR, 2, '0') AS clock, 'speaker' || vec_id AS folded FROM a")
def _(spark, d):
    selection.register_functions(spark)
    S.table(spark, d, "embeddings").selectExpr("vec_id", "cast(embedding AS array<double>) AS v").createOrReplaceTempView("lodestrata_vectors")
    return spark.sql("SELECT vec_id, round(dot(v, v), 5) AS square, round(unit_vector(v)[0], 5) AS v0, hms(vec_id) AS clock, fold_name(concat('Speaker #', vec_id)) AS folded FROM lodestrata_vectors")


@query("sql_slug", ORACLES["slug"])
def _(spark, d):
    selection.register_functions(spark)
    S.table(spark, d, "documents").createOrReplaceTempView("lodestrata_documents")
    return spark.sql("SELECT doc_id, slug(split(text, '\\n')[0]) AS slug FROM lodestrata_documents WHERE text IS NOT NULL")


# --- profiles ---

_MEMBER = f"WITH {_ATOM}, mem AS (SELECT label::BIGINT AS speaker_id, vec_id::BIGINT AS id, sec AS seconds, v FROM atom WHERE label % 2 = 0), ex AS (SELECT *, row_number() OVER (PARTITION BY speaker_id ORDER BY seconds DESC, condition) AS o FROM (SELECT label::BIGINT AS speaker_id, CASE WHEN k = 1 THEN 'room' ELSE 'phone' END AS condition, v AS ev, sec AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM atom) WHERE k <= 2 AND label % 2 = 0))"
_NEAR = "sims AS (SELECT m.speaker_id, m.id, m.seconds, condition, o, list_inner_product(m.v, ev) AS sim FROM mem m JOIN ex USING (speaker_id))"
_FAR = f"{_NEAR}, far AS (SELECT speaker_id, id, v FROM mem WHERE id NOT IN (SELECT id FROM sims WHERE sim >= 0.2)), agree AS (SELECT a.id, count(*) AS n FROM far a JOIN far b ON a.speaker_id = b.speaker_id AND a.id <> b.id AND list_inner_product(a.v, b.v) >= 0.2 GROUP BY a.id)"


def _members(spark, d):
    return S.atoms(spark, d).filter("label % 2 = 0").select(F.col("label").cast("long").alias("speaker_id"), F.col("vec_id").alias("id"), F.col("sec").alias("seconds"), "v")


@query("profile_members", f"{_MEMBER}, {_NEAR} SELECT speaker_id, id, seconds, arg_max(condition, (sim, -o)) AS condition, round(max(sim), 5) AS sim FROM sims GROUP BY ALL")
def _(spark, d):
    return profiles.membership(_members(spark, d), S.exemplars(spark, d)).withColumn("sim", F.round("sim", 5))


@query("far_agreement", f"{_MEMBER}, {_FAR} SELECT far.id, coalesce(n, 0)::BIGINT AS agree FROM far LEFT JOIN agree USING (id)")
def _(spark, d):
    far = _members(spark, d).join(profiles.membership(_members(spark, d), S.exemplars(spark, d)).filter("sim < 0.2").select("id"), "id", "left_semi")
    return profiles.agreement(far, 0.2)


@query("confident_members", f"{_MEMBER}, {_FAR} SELECT speaker_id, id FROM mem WHERE id NOT IN (SELECT id FROM far) OR id IN (SELECT id FROM agree WHERE n >= 3)")
def _(spark, d):
    return profiles.confident(_members(spark, d), S.exemplars(spark, d), 0.2, 4).select("speaker_id", "id")


@query("covered_members")
def _(spark, d):
    return profiles.cover_members(_members(spark, d), -0.05).select("speaker_id", "id", "owner", "pick")


@query("refreshed_profiles", f"{_MEMBER}, {_FAR} SELECT speaker_id, sum(seconds) AS seconds FROM mem WHERE id NOT IN (SELECT id FROM far) OR id IN (SELECT id FROM agree WHERE n >= 3) GROUP BY speaker_id")
def _(spark, d):
    a = _members(spark, d)
    c = a.select(F.col("speaker_id").alias("group_id"), "id", "seconds", "v")
    named = a.select(F.col("speaker_id").alias("group_id"), "speaker_id").distinct()
    new = profiles.refresh(store.Store(S.speakers(spark, d), named, c, S.exemplars(spark, d)), replace(DEFAULTS, keep_exemplar=0.2, cover=-0.05)).exemplars
    return new.filter(F.startswith("condition", F.lit("auto-"))).groupBy("speaker_id").agg(F.sum("seconds").alias("seconds"))


@query("merged_profile", f"{_MEMBER}, w AS (SELECT speaker_id, condition, seconds, unnest(ev) AS x, generate_subscripts(ev, 1) AS i FROM ex WHERE speaker_id = 2), s AS (SELECT speaker_id, i, sum(x * seconds) AS x, sum(seconds) AS seconds FROM w GROUP BY ALL), q AS (SELECT speaker_id, sqrt(sum(x * x)) AS l FROM s GROUP BY 1) SELECT speaker_id, 'study' AS condition, max(seconds) AS seconds, list(round(x / l, 5) + 0.0 ORDER BY i) AS v FROM s JOIN q USING (speaker_id) GROUP BY speaker_id UNION ALL SELECT speaker_id, condition, seconds, list_transform(ev, lambda x: round(x, 5) + 0.0) FROM ex WHERE speaker_id <> 2")
def _(spark, d):
    return profiles.merge_profiles(S.exemplars(spark, d), 2, "room", "phone", "study").select("speaker_id", "condition", "seconds", F.transform("v", lambda x: F.round(x, 5) + 0.0).alias("v"))


@query("split_profile", f"{_MEMBER}, {_NEAR}, own AS (SELECT id, seconds, arg_max(condition, (sim, -o)) AS condition FROM sims WHERE speaker_id = 2 GROUP BY ALL) SELECT condition, seconds FROM ex WHERE speaker_id = 2 AND condition <> 'room' UNION ALL SELECT 'auto', sum(seconds) FROM own WHERE condition = 'room'")
def _(spark, d):
    e = profiles.split_profile(_members(spark, d), S.exemplars(spark, d), 2, "room", 3).filter("speaker_id = 2")
    return e.groupBy(F.regexp_replace("condition", r"-\d+$", "").alias("condition")).agg(F.sum("seconds").alias("seconds"))


@query("group_samples", f"WITH {_SEG}, a AS (SELECT meeting_id, gid AS cluster, left(string_agg(text, ' ' ORDER BY seg_idx), 200) AS sample, sum(n_words)::DOUBLE AS seconds FROM seg GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY meeting_id % 7, cluster ORDER BY seconds DESC, meeting_id) AS k FROM a) SELECT meeting_id % 7 * 10 + right(cluster, 1)::BIGINT AS group_id, arg_min(sample, k) AS sample FROM b WHERE k <= 3 AND length(sample) > 60 GROUP BY 1")
def _(spark, d):
    s = S.segments(spark, d)
    c = s.groupBy("meeting_id", F.col("gid").alias("cluster")).agg(F.sum("n_words").cast("double").alias("seconds")).withColumn("group_id", (F.col("meeting_id") % 7 * 10 + F.substring("cluster", 3, 1).cast("long")).cast("long"))
    return profiles.group_samples(c, reports.text_samples(s).withColumnRenamed("gid", "cluster"))


# --- windows and references ---


@query("slide_windows", f"WITH {_SEG}, m AS (SELECT meeting_id, max(end_s) AS dur FROM seg GROUP BY 1), w AS (SELECT meeting_id, dur, unnest(range(0, 1 + floor((dur - 1) / 25)::BIGINT)) AS win FROM m WHERE dur >= 1) SELECT meeting_id, win, win * 25.0::DOUBLE AS audio_lo, round(least(win * 25 + 30, dur), 3) AS audio_hi, win * 25.0::DOUBLE + CASE WHEN win > 0 THEN 5 ELSE 0 END AS core_lo FROM w")
def _(spark, d):
    m = S.segments(spark, d).groupBy("meeting_id").agg(F.max("end_s").alias("duration"))
    return assembly.slide_windows(m, 5.0).withColumn("audio_hi", F.round("audio_hi", 3))


@query("single_window", f"WITH {_SEG} SELECT round(least(max(end_s), 130560 / 32.5::DOUBLE), 3) AS window_s FROM seg")
def _(spark, d):
    m = S.segments(spark, d).groupBy("meeting_id").agg(F.max("end_s").alias("duration"))
    return assembly.single_window(m).select(F.round("window_s", 3).alias("window_s"))


@query("complete_recordings", f"WITH {_SEG}, p AS (SELECT DISTINCT meeting_id, win FROM seg) SELECT meeting_id, count(*) AS n_windows, count(*) FILTER (WHERE win % 3 <> 2) AS n_decoded, count(*) = count(*) FILTER (WHERE win % 3 <> 2) AS complete FROM p GROUP BY meeting_id")
def _(spark, d):
    s = S.segments(spark, d)
    return assembly.complete_recordings(s.filter("win % 3 <> 2"), s)


@query("snapped_windows")
def _(spark, d):
    return recovery.snapped_windows(_levels(spark, d), snap=5.0, size=30.0, hop=2.0)


@query("reference_overlap", f"WITH {_SEG}, rt AS (SELECT meeting_id, gid AS speaker, start_s + 1 AS lo, end_s + 1 AS hi FROM seg WHERE end_s > start_s AND seg_idx % 2 = 0), o AS (SELECT s.meeting_id, local_label, speaker, sum(least(end_s, hi) - greatest(start_s, lo)) AS seconds FROM seg s JOIN rt ON s.meeting_id = rt.meeting_id AND start_s < hi AND lo < end_s GROUP BY ALL), al AS (SELECT meeting_id, local_label, sum(end_s - start_s) AS a FROM seg GROUP BY ALL), f AS (SELECT meeting_id, local_label, NULL AS speaker, greatest(a - coalesce((SELECT sum(seconds) FROM o WHERE o.meeting_id = al.meeting_id AND o.local_label = al.local_label), 0), 0) AS seconds FROM al) SELECT meeting_id, local_label, speaker, round(seconds, 3) AS seconds FROM o WHERE seconds > 1e-6 UNION ALL SELECT meeting_id, local_label, speaker, round(seconds, 3) FROM f WHERE seconds > 1e-6")
def _(spark, d):
    s = S.segments(spark, d)
    t = s.filter("seg_idx % 2 = 0").select("meeting_id", F.col("gid").alias("speaker"), (F.col("start_s") + 1).alias("start_s"), (F.col("end_s") + 1).alias("end_s"))
    return assembly.reference_overlap(s, t, "meeting_id", "local_label", bucket_s=60.0).filter("seconds > 1e-6").withColumn("seconds", F.round("seconds", 3))


# --- sequential rules ---


@query("meeting_labels")
def _(spark, d):
    return recovery.label_meetings(S.atoms(spark, d), S.bank(spark, d, 2).filter("person % 2 = 0"))


@query("trimmed_seams")
def _(spark, d):
    c = _chunks(S.table(spark, d, "documents").filter("text is not null")).withColumn("text", F.array_join("words", " "))
    return recovery.trim_seams_of(c)


@query("tagged_pieces", r"""WITH a AS (SELECT meeting_id, regexp_extract_all(t, '\[(\d+(?:\.\d+)?)\]\[(S\d+)\]([^\[]*)\[(\d+(?:\.\d+)?)\]', 2) AS l, regexp_extract_all(t, '\[(\d+(?:\.\d+)?)\]\[(S\d+)\]([^\[]*)\[(\d+(?:\.\d+)?)\]', 1) AS s FROM (SELECT conv_id AS meeting_id, string_agg('[' || turn || ']' || CASE role WHEN 'user' THEN '[S01]' WHEN 'assistant' THEN '[S02]' ELSE '[S03]' END || replace(text, '[', '(') || '[' || (turn + 1) || ']', '' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)) SELECT meeting_id, unnest(s)::DOUBLE AS start_in, unnest(l) AS local_label FROM a""")
def _(spark, d):
    c = S.table(spark, d, "conversations")
    tag = F.when(F.col("role") == "user", "[S01]").when(F.col("role") == "assistant", "[S02]").otherwise("[S03]")
    t = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("]"), tag, F.replace("text", F.lit("["), F.lit("(")), F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("]"))
    m = c.withColumn("t", t).groupBy(F.col("conv_id").alias("meeting_id")).agg(F.expr("listagg(t, '') WITHIN GROUP (ORDER BY turn)").alias("t"))
    return m.select("meeting_id", F.explode(recovery.parse_tagged(F.col("t"))).alias("x")).select("meeting_id", "x.start_in", "x.local_label")
