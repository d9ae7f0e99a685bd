"""Queries over voices and the people behind them: pooling, names, suggestions, the store, and how all that is shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import clustering, identity, matching, naming, packing, profiles, reports, selection, store
from lodestrata.plans.registry import ATOM, SEG, STORE, query
from lodestrata.sources import tables as S

# every second segment has a vector
_VEC = f"{SEG}, vec AS (SELECT meeting_id, seg_idx, n_words * 0.4::DOUBLE AS dur_used, [n_words, seg_idx + 1]::DOUBLE[] AS v FROM seg WHERE seg_idx % 2 = 1)"


def _vectors(spark, d):
    s = S.segments(spark, d)
    return s, s.filter("seg_idx % 2 = 1").select("meeting_id", "seg_idx", (F.col("n_words") * 0.4).alias("dur_used"), F.array(F.col("n_words").cast("double"), (F.col("seg_idx") + 1).cast("double")).alias("v"))


def _round(d, digits: int, *names: str):
    return d.select(*(F.round(c, digits).alias(c) if c in names else c for c in d.columns))


@query("voice_atoms", f"WITH {_VEC}, a AS (SELECT meeting_id, win, local_label, avg(v[1]) AS x, avg(v[2]) AS y, sum(end_s - start_s) AS sec, arg_min(start_s, seg_idx) AS start, count(*) AS n FROM seg JOIN vec USING (meeting_id, seg_idx) GROUP BY ALL) SELECT meeting_id, win, local_label, round(x / sqrt(x * x + y * y), 6) AS v0, round(y / sqrt(x * x + y * y), 6) AS v1, round(sec, 3) AS sec, round(start, 3) AS start, n FROM a")
def _(spark, d):
    a = matching.pool_atoms(*_vectors(spark, d))
    return _round(a.select("meeting_id", "win", "local_label", F.col("v")[0].alias("v0"), F.col("v")[1].alias("v1"), "sec", "start", "n"), 6, "v0", "v1").withColumn("sec", F.round("sec", 3)).withColumn("start", F.round("start", 3))


@query("pool_stats", f"WITH {_VEC}, a AS (SELECT meeting_id, win, local_label, coalesce(sum(dur_used), 0) AS s, count(dur_used) AS n FROM seg LEFT JOIN vec USING (meeting_id, seg_idx) GROUP BY ALL) SELECT meeting_id, count(*) AS n_labels, count(*) FILTER (WHERE n > 0) AS embeddable, count(*) FILTER (WHERE n = 0) AS empty, count(*) FILTER (WHERE s >= 2) AS core, round(median(s), 3) AS median_s, round(sum(s), 3) AS total_s FROM a GROUP BY meeting_id")
def _(spark, d):
    return _round(reports.pool_stats(selection.pool_all(*_vectors(spark, d), "meeting_id", "win", "local_label")), 3, "median_s", "total_s")


# --- who is shown ---

_SHOWN = f"""{SEG}, s AS (SELECT meeting_id, seg_idx, start_s, end_s, text, CASE WHEN seg_idx % 7 = 6 THEN NULL WHEN seg_idx % 9 = 8 THEN 'G-1' ELSE gid END AS gid FROM seg),
named AS (SELECT DISTINCT meeting_id, 'G00' AS gid, 'Person ' || meeting_id AS name FROM seg WHERE meeting_id % 3 = 0),
a AS (SELECT meeting_id, gid, sum(end_s - start_s) AS seconds, min(seg_idx) AS f, gid IS NOT NULL AND NOT starts_with(gid, 'G-') AS real FROM s GROUP BY ALL),
b AS (SELECT a.*, name, row_number() OVER (PARTITION BY a.meeting_id, real ORDER BY seconds DESC, f) AS k FROM a LEFT JOIN named ON named.meeting_id = a.meeting_id AND named.gid = a.gid),
who AS (SELECT meeting_id, gid, seconds, real, name IS NOT NULL AS named, coalesce(name, CASE WHEN real THEN 'Speaker ' || k END, 'UNKNOWN') AS shown FROM b)"""


def _shown(spark, d):
    s = S.segments(spark, d).withColumn("gid", F.when(F.col("seg_idx") % 7 == 6, None).when(F.col("seg_idx") % 9 == 8, "G-1").otherwise(F.col("gid")))
    names = s.filter("meeting_id % 3 = 0").select("meeting_id").distinct().select("meeting_id", F.lit("G00").alias("gid"), F.concat(F.lit("Person "), F.col("meeting_id").cast("string")).alias("name"))
    return s, names


@query("shown_speakers", f"WITH {_SHOWN} SELECT meeting_id, gid, shown, round(seconds, 3) AS seconds, named FROM who")
def _(spark, d):
    return _round(reports.shown_speakers(*_shown(spark, d)), 3, "seconds")


@query(
    "rendered_transcripts",
    f"""WITH {_SHOWN}, l AS (SELECT s.*, shown FROM s JOIN who ON who.meeting_id = s.meeting_id AND who.gid IS NOT DISTINCT FROM s.gid), hd AS (SELECT *, shown IS DISTINCT FROM lag(shown) OVER (PARTITION BY meeting_id ORDER BY seg_idx) AS ch FROM l),
body AS (SELECT meeting_id, count(*) AS turns, string_agg(CASE WHEN ch THEN chr(10) || '[' || floor(start_s / 3600)::INT || ':' || lpad(floor(start_s % 3600 / 60)::INT::VARCHAR, 2, '0') || ':' || lpad(floor(start_s % 60)::INT::VARCHAR, 2, '0') || '] ' || shown || chr(10) ELSE '' END || '  ' || text, chr(10) ORDER BY seg_idx) AS b, max(end_s) + 1.7 AS dur FROM hd GROUP BY meeting_id),
n AS (SELECT meeting_id, count(*) FILTER (WHERE real) AS n, count(*) FILTER (WHERE real AND named) AS k FROM who GROUP BY 1)
SELECT meeting_id, 'Meeting ' || meeting_id || chr(10) || printf('%.1f', dur / 60) || ' min · ' || turns || ' turns · ' || n || ' speakers' || CASE WHEN k > 0 THEN ', ' || k || ' named' ELSE '' END || chr(10) || repeat('=', 66) || chr(10) || b || chr(10) AS text FROM body JOIN n USING (meeting_id)""",
)
def _(spark, d):
    s, names = _shown(spark, d)
    m = s.groupBy("meeting_id").agg((F.max("end_s") + 1.7).alias("duration")).withColumn("title", F.concat(F.lit("Meeting "), F.col("meeting_id").cast("string")))
    return reports.render_transcripts(s, m, names)


# --- names ---

# a quarter of the atoms is nobody's, a quarter provisional, the rest known
_FOUND = "found AS (SELECT *, CASE vec_id % 4 WHEN 1 THEN 'P' || (vec_id % 3) WHEN 3 THEN NULL ELSE 'K' || label END AS person FROM atom)"


def _found(spark, d):
    a = S.atoms(spark, d)
    person = F.when(F.col("vec_id") % 4 == 1, F.concat(F.lit("P"), (F.col("vec_id") % 3).cast("string"))).when(F.col("vec_id") % 4 != 3, F.concat(F.lit("K"), F.col("label").cast("string")))
    return a, a.select("meeting_id", "vec_id", person.alias("person"))


_TAGGED = f"{ATOM}, {_FOUND}, n AS (SELECT meeting_id, person, row_number() OVER (PARTITION BY meeting_id ORDER BY f) - 1 AS label FROM (SELECT meeting_id, person, min((win, local_label, vec_id)) AS f FROM found WHERE person IS NOT NULL GROUP BY ALL)), tg AS (SELECT f.meeting_id, vec_id, sec, coalesce(n.label, -1)::INT AS label, CASE WHEN starts_with(f.person, 'K') THEN substr(f.person, 2)::BIGINT END AS person FROM found f LEFT JOIN n ON n.meeting_id = f.meeting_id AND n.person = f.person)"


@query("tagged_voices", f"WITH {_TAGGED} SELECT meeting_id, vec_id, label, person FROM tg")
def _(spark, d):
    return naming.tagged_voices(*_found(spark, d))


@query("label_info", f"WITH {_TAGGED} SELECT meeting_id, count(DISTINCT CASE WHEN label >= 0 THEN label END) AS k, count(DISTINCT CASE WHEN person IS NOT NULL THEN label END) AS named, count(*) FILTER (WHERE label < 0) AS unresolved, round(sum(CASE WHEN person IS NOT NULL THEN sec ELSE 0 END) / sum(sec), 4) AS named_share FROM tg GROUP BY meeting_id")
def _(spark, d):
    a, found = _found(spark, d)
    return naming.label_info(a, naming.tagged_voices(a, found))


_OPEN = f"{ATOM}, {_FOUND}, op AS (SELECT *, coalesce(person, 'UNKNOWN') AS tag FROM found WHERE person IS NULL OR starts_with(person, 'P'))"


@query(
    "suggested_voices",
    f"""WITH {_OPEN}, about AS (SELECT meeting_id, tag, sum(sec) AS seconds, min(vec_id) AS start FROM op GROUP BY ALL),
e AS (SELECT meeting_id, tag, i, sum(v[i] * sec) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM op) GROUP BY ALL), n AS (SELECT meeting_id, tag, sqrt(sum(x * x)) AS l FROM e GROUP BY ALL), pv AS (SELECT meeting_id, tag, list(x / l ORDER BY i) AS v FROM e JOIN n USING (meeting_id, tag) GROUP BY ALL),
sc AS (SELECT meeting_id, tag, person, max(list_inner_product(v, bv)) AS sim FROM pv, bank WHERE k <= 2 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, tag ORDER BY sim DESC, person) AS rank, sim - lead(sim) OVER (PARTITION BY meeting_id, tag ORDER BY sim DESC, person) AS gap FROM sc)
SELECT meeting_id, tag, seconds, start, rank::INT AS rank, person, round(sim, 6) AS sim, round(max(CASE WHEN rank = 1 THEN gap END) OVER (PARTITION BY meeting_id, tag), 6) AS margin, sim >= 0.3 AS over FROM r JOIN about USING (meeting_id, tag) QUALIFY rank <= 4""",
)
def _(spark, d):
    a, found = _found(spark, d)
    s = naming.suggest_voices(a.join(found, ["meeting_id", "vec_id"]).withColumn("start", F.col("vec_id")), S.bank(spark, d, 2), 4, 0.3)
    return _round(s, 6, "sim", "margin")


@query("voice_samples", f"WITH {SEG}, v AS (SELECT meeting_id, win, local_label, min(seg_idx) AS vec_id, min(start_s) AS start, CASE WHEN win % 3 = 0 THEN NULL WHEN win % 3 = 1 THEN 'P' || (win % 2) ELSE 'K1' END AS person FROM seg GROUP BY ALL), f AS (SELECT meeting_id, coalesce(person, 'UNKNOWN') AS tag, arg_min(win, (start, vec_id)) AS win, arg_min(local_label, (start, vec_id)) AS local_label FROM v WHERE person IS NULL OR starts_with(person, 'P') GROUP BY ALL) SELECT meeting_id, tag, trim(left(string_agg(text, ' ' ORDER BY seg_idx), 88)) AS sample FROM seg JOIN f USING (meeting_id, win, local_label) GROUP BY ALL")
def _(spark, d):
    s = S.segments(spark, d)
    v = s.groupBy("meeting_id", "win", "local_label").agg(F.min("seg_idx").alias("vec_id"), F.min("start_s").alias("start"))
    v = v.withColumn("person", F.when(F.col("win") % 3 == 1, F.concat(F.lit("P"), (F.col("win") % 2).cast("string"))).when(F.col("win") % 3 == 2, "K1"))
    return naming.voice_samples(v, s)


# --- the store ---


@query("inherited_groups", f"WITH {ATOM}, {STORE}, m AS (SELECT meeting_id % 7 AS link, meeting_id * 100 + group_id AS id, seconds, CASE WHEN meeting_id % 2 = 0 THEN group_id END AS group_id FROM clu), b AS (SELECT link, speaker_id, sum(seconds) AS s, arg_min(group_id, id) AS group_id FROM m LEFT JOIN (SELECT * FROM grp WHERE speaker_id IS NOT NULL) USING (group_id) GROUP BY ALL), c AS (SELECT *, sum(s) OVER (PARTITION BY link) AS al FROM b), d AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY s DESC, group_id DESC) AS k FROM c WHERE speaker_id IS NOT NULL) SELECT link, group_id, speaker_id, round(s / al, 6) AS share FROM d WHERE k = 1 AND s / al >= 0.08")
def _(spark, d):
    c = S.clusters(spark, d).select((F.col("meeting_id") % 7).alias("link"), (F.col("meeting_id") * 100 + F.col("group_id")).alias("id"), "seconds", F.when(F.col("meeting_id") % 2 == 0, F.col("group_id")).alias("group_id"))
    return _round(reports.inherited_groups(c, S.groups(spark, d), 0.08), 6, "share")


@query("store_counts", f"WITH {ATOM}, {STORE} SELECT (SELECT count(*) FROM clu) AS clusters, (SELECT count(*) FROM clu WHERE meeting_id % 4 <> 0) AS grouped, (SELECT count(*) FROM grp) AS groups, (SELECT count(speaker_id) FROM grp) AS named_groups, (SELECT count(DISTINCT meeting_id) FROM clu JOIN grp USING (group_id) WHERE speaker_id IS NOT NULL AND meeting_id % 4 <> 0) AS named_meetings")
def _(spark, d):
    c = S.clusters(spark, d).withColumn("group_id", F.when(F.col("meeting_id") % 4 != 0, F.col("group_id")))
    return reports.store_counts(c, S.groups(spark, d))


@query("meetings_of_names", f"WITH {ATOM}, {STORE} SELECT name, count(DISTINCT meeting_id) AS meetings FROM spk LEFT JOIN (SELECT meeting_id, speaker_id FROM clu JOIN grp USING (group_id) WHERE meeting_id % 4 = 1 AND group_id <> 6) c ON c.speaker_id = spk.id GROUP BY name")
def _(spark, d):
    return reports.meetings_of_names(S.clusters(spark, d).filter("meeting_id % 4 = 1 AND group_id <> 6"), S.groups(spark, d), S.speakers(spark, d))


@query("broken_store", f"WITH {ATOM}, {STORE}, s AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'Same' ELSE name END AS name FROM spk WHERE id <> 2), g AS (SELECT * FROM grp WHERE group_id <> 5), c AS (SELECT * FROM clu UNION ALL SELECT * FROM clu WHERE meeting_id % 3 = 0), e AS (SELECT speaker_id, 'one' AS condition FROM exe) SELECT * FROM (VALUES ('groups.speaker', (SELECT count(*) FROM g WHERE speaker_id IS NOT NULL AND speaker_id NOT IN (SELECT id FROM s))), ('exemplars.speaker', (SELECT count(*) FROM e WHERE speaker_id NOT IN (SELECT id FROM s))), ('clusters.group', (SELECT count(*) FROM c WHERE group_id IS NOT NULL AND group_id NOT IN (SELECT group_id FROM g))), ('speakers.name', (SELECT count(*) FROM (SELECT name FROM s GROUP BY 1 HAVING count(*) > 1))), ('clusters.key', (SELECT count(*) FROM (SELECT 1 FROM c GROUP BY meeting_id, cluster HAVING count(*) > 1))), ('exemplars.key', (SELECT count(*) FROM (SELECT 1 FROM e GROUP BY speaker_id, condition HAVING count(*) > 1)))) t(problem, n)")
def _(spark, d):
    s = S.speakers(spark, d).filter("id <> 2").withColumn("name", F.when(F.col("id") % 4 == 0, "Same").otherwise(F.col("name")))
    c = S.clusters(spark, d)
    e = S.exemplars(spark, d).withColumn("condition", F.lit("one"))
    return store.integrity(store.Store(s, S.groups(spark, d).filter("group_id <> 5"), c.unionByName(c.filter("meeting_id % 3 = 0")), e))


@query("meeting_clashes", f"WITH {ATOM}, {STORE} SELECT meeting_id, group_id % 4 AS grp, count(*) AS n FROM clu WHERE seconds >= 60 GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return identity.link_conflicts(S.clusters(spark, d).filter("seconds >= 60").select("meeting_id", (F.col("group_id") % 4).alias("grp")))


_MODEL = "CASE WHEN vec_id % 3 = 0 THEN 'old' ELSE 'new' END"


@query("linkable_clusters", f"WITH {ATOM}, c AS (SELECT meeting_id, label, {_MODEL} AS embed_model, sum(sec) AS seconds FROM atom GROUP BY ALL) SELECT * FROM c WHERE embed_model = 'new' AND seconds >= 60")
def _(spark, d):
    model = F.when(F.col("vec_id") % 3 == 0, "old").otherwise("new").alias("embed_model")
    return selection.linkable(S.atoms(spark, d).groupBy("meeting_id", "label", model).agg(F.sum("sec").alias("seconds")), "new")


@query("model_bank", f"WITH {ATOM}, {STORE}, e AS (SELECT speaker_id, condition, seconds, v, CASE WHEN condition = 'room' OR speaker_id = 6 THEN 'new' ELSE 'old' END AS m FROM exe) SELECT name, speaker_id AS person, condition, seconds, list_transform(v, lambda x: round(x, 5)) AS v FROM e JOIN spk ON speaker_id = id WHERE m = 'new' AND id <> 4")
def _(spark, d):
    e = S.exemplars(spark, d).withColumn("embed_model", F.when((F.col("condition") == "room") | (F.col("speaker_id") == 6), "new").otherwise("old"))
    roster = S.table(spark, d, "embeddings").filter("label <> 4").select(F.concat(F.lit("Speaker_"), F.col("label").cast("string")).alias("name")).distinct()
    return selection.named_bank(e, S.speakers(spark, d), "new", roster).withColumn("v", F.transform("v", lambda x: F.round(x, 5)))


@query("profile_suspects", f"WITH {ATOM}, {STORE}, f AS (SELECT a.vec_id AS id, a.label::BIGINT AS speaker_id, a.sec AS seconds, max(list_inner_product(a.v, exe.v)) AS sim FROM atom a JOIN exe ON exe.speaker_id = a.label GROUP BY ALL) SELECT speaker_id, id, seconds, round(sim, 5) AS sim FROM f WHERE sim < 0.5 AND seconds >= 10 ORDER BY f.sim, id LIMIT 10")
def _(spark, d):
    m = S.atoms(spark, d).filter("label % 2 = 0").select(F.col("label").cast("long").alias("speaker_id"), F.col("vec_id").alias("id"), F.col("sec").alias("seconds"), "v")
    return _round(selection.weak_suspects(profiles.membership(m, S.exemplars(spark, d)), least=10.0).select("speaker_id", "id", "seconds", "sim"), 5, "sim")


# --- batches and strings ---


@query(
    "packed_batches",
    """WITH RECURSIVE i AS (SELECT event_id AS id, value AS length, row_number() OVER (ORDER BY value, event_id) - 1 AS p FROM events),
n AS (SELECT p, length, least(p + 32, (SELECT count(*) FROM i x WHERE x.length <= 1.15::DOUBLE * i.length)) AS nx FROM i), s AS (SELECT 0::BIGINT AS p, 0::BIGINT AS batch UNION ALL SELECT nx, batch + 1 FROM s JOIN n USING (p) WHERE nx < (SELECT count(*) FROM i))
SELECT id, length, batch FROM i ASOF JOIN s ON i.p >= s.p""",
)
def _(spark, d):
    return packing.pack(S.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("length")), part_rows=1000)


@query("pooled_windows", f"WITH {SEG}, m AS (SELECT meeting_id % 4 AS queue, meeting_id, max(win) + 1 AS n FROM seg GROUP BY ALL), w AS (SELECT queue, meeting_id, n, unnest(range(0, n)) AS win FROM m), p AS (SELECT *, (row_number() OVER (PARTITION BY queue ORDER BY meeting_id, win) - 1) // 16 AS batch FROM w) SELECT queue, batch, meeting_id AS recording, min(win) AS first, max(win) AS last, max(win) = n - 1 AS completes FROM p GROUP BY queue, batch, meeting_id, n")
def _(spark, d):
    m = S.segments(spark, d).groupBy((F.col("meeting_id") % 4).alias("queue"), F.col("meeting_id").alias("recording")).agg((F.max("win") + 1).alias("n_windows"), F.max("end_s").alias("duration"))
    return packing.pool_windows(m.withColumn("place", F.col("recording")), 16, 1e9)


@query("scalar_formats", r"""SELECT c_custkey, regexp_replace(regexp_replace('  ' || c_name || '//x', '[^\p{L}\p{N}._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS squeezed, regexp_replace('[' || c_name || ']*?', '([\[\]?*])', '[\1]', 'g') AS escaped, regexp_replace(replace(c_name, '#', '-'), '-[^-]*$', '') AS stem, 'w' || lpad((c_custkey % 1200)::VARCHAR, greatest(3, length((c_custkey % 1200)::VARCHAR))::INT, '0') || '_S0' || (c_custkey % 3) AS tag, repeat('#', greatest(round_even((c_custkey % 64 - 8) / 40.0::DOUBLE * 20, 0), 0)::INT) AS bar,
CASE WHEN c_custkey % 5 = 0 THEN 'Listen.' ELSE 'Listen.' || chr(10) || 'Spell: ' || c_name || ', ' || c_nationkey || '.' END AS prompt, round(c_custkey * 37 / 3600.0::DOUBLE, 6) AS hours FROM customer""")
def _(spark, d):
    c = S.table(spark, d, "customer")
    terms = F.when(F.col("c_custkey") % 5 == 0, " , ").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" ,, "), F.col("c_nationkey").cast("string")))
    return c.select(
        "c_custkey", T.safe_squeezed(F.concat(F.lit("  "), "c_name", F.lit("//x"))).alias("squeezed"), T.glob_escape(F.concat(F.lit("["), "c_name", F.lit("]*?"))).alias("escaped"), T.stem(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("stem"),
        T.voice_tag(F.col("c_custkey") % 1200, F.concat(F.lit("S0"), (F.col("c_custkey") % 3).cast("string"))).alias("tag"), T.bar((F.col("c_custkey") % 64 - 8) / F.lit(40.0)).alias("bar"), T.glossary_prompt(terms, "Listen.", "Spell: ").alias("prompt"), F.round(T.hours(F.col("c_custkey") * 37), 6).alias("hours"),
    )


@query("event_seconds", "SELECT event_id, round(epoch_us(ts) / 1e6, 3) AS at FROM events")
def _(spark, d):
    return S.table(spark, d, "events").select("event_id", F.round(T.since_epoch(F.col("ts")), 3).alias("at"))


# --- clusters by given labels, and the arms for comparison ---


@query("final_centroids", f"WITH {ATOM}, l AS (SELECT *, label % 4 - 1 AS cluster FROM atom), e AS (SELECT meeting_id, cluster, i, sum(v[i] * sec) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM l WHERE cluster >= 0) GROUP BY ALL), n AS (SELECT meeting_id, cluster, sqrt(sum(x * x)) AS nrm FROM e GROUP BY ALL), c AS (SELECT meeting_id, cluster, sum(sec) AS seconds, count(*) AS n FROM l GROUP BY ALL) SELECT meeting_id, cluster::BIGINT AS cluster, list(round(x / nrm, 5) + 0.0 ORDER BY i) AS v, any_value(seconds) AS seconds, any_value(c.n) AS n FROM e JOIN n USING (meeting_id, cluster) JOIN c USING (meeting_id, cluster) GROUP BY ALL")
def _(spark, d):
    a = S.atoms(spark, d)
    c = clustering.final_centroids(a, a.select("meeting_id", "vec_id", (F.col("label") % 4 - 1).cast("long").alias("cluster")))
    return c.select("meeting_id", "cluster", F.transform("v", lambda x: F.round(x, 5) + 0.0).alias("v"), "seconds", "n")


@query("estimated_k")
def _(spark, d):
    return clustering.estimate_k(S.atoms(spark, d))


@query("plain_clusters")
def _(spark, d):
    return clustering.plain_clusters(S.atoms(spark, d))
