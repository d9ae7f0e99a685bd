"""Names: given to groups, suggested for voices nobody knows, and written back to meetings that are on file."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.vectors import dot
from lodestrata.operators import identity, matching, profiles, recovery, reports
from lodestrata.operators.store import Store, near_names, pool_exemplars
from lodestrata.params import DEFAULTS
from lodestrata.runtime import settled

_EXEMPLAR = ["speaker_id", "condition", "v", "seconds"]


def name_group(store: Store, group_id: int, name: str | None = None, speaker_id: int | None = None, condition: str | None = None, near_ok: bool = False, new_id: int | None = None, p=DEFAULTS) -> Store:
    """The group's voice gets a name, and the person's exemplars what the group says.

    ``speaker_id`` attaches the group to a person there is, whatever ``name``
    says. Else a name that a speaker has already stands for that speaker; a
    new one makes a speaker (``new_id``, or the next id) unless it is nearly
    another's and ``near_ok`` doesn't allow that. With ``condition`` the
    group's clusters, weighted by seconds, are pooled into that exemplar;
    without, the person's ``auto-`` exemplars are drawn anew from all clusters.
    A group that doesn't exist or has no clusters is an error.
    """
    spark, s = store.speakers.sparkSession, store.speakers
    if store.groups.filter(F.col("group_id") == group_id).isEmpty():
        raise ValueError(f"no group {group_id}")
    members = store.clusters.filter(F.col("group_id") == group_id)
    if members.isEmpty():
        raise ValueError(f"group {group_id} has no members")
    if speaker_id is not None:
        if s.filter(F.col("id") == speaker_id).isEmpty():
            raise ValueError(f"no speaker {speaker_id}")
        who = speaker_id
    elif not name:
        raise ValueError("a name for a new person, or the id of one in the store")
    else:
        found = s.filter(F.col("name") == name).select("id").first()
        if found is None:
            near = [r["b_name"] for r in near_names(spark.createDataFrame([(name,)], "name string"), s.select("name"), p.near_name_edits).orderBy("b_name").limit(5).collect()]
            if near and not near_ok:
                raise ValueError(f"{name} is close to {', '.join(near)}")
            who = new_id if new_id is not None else s.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
            if not s.filter(F.col("id") == who).isEmpty():
                raise ValueError(f"speaker {who} exists")
            s = s.unionByName(spark.createDataFrame([(who, name)], "id long, name string"), allowMissingColumns=True)
        else:
            who = found["id"]
    groups = store.groups.withColumn("speaker_id", F.when(F.col("group_id") == group_id, F.lit(who)).otherwise(F.col("speaker_id")).cast("long"))
    named = replace(store, speakers=s, groups=groups)
    own = named.exemplars.filter(F.col("speaker_id") == who)
    if condition is not None:
        new = members.select(F.lit(who).cast("long").alias("speaker_id"), F.lit(condition).alias("condition"), "v", "seconds")
        same = F.col("condition") == condition
        own = own.filter(~F.coalesce(same, F.lit(False))).unionByName(pool_exemplars(own.filter(same).select(_EXEMPLAR), new), allowMissingColumns=True)
    else:
        one = replace(named, groups=groups.filter(F.col("speaker_id") == who), exemplars=own)
        own = profiles.refresh(one, p).exemplars
    return replace(named, exemplars=settled(named.exemplars.filter(F.col("speaker_id") != who).unionByName(own, allowMissingColumns=True)))


def tagged_voices(atoms: DataFrame, found: DataFrame) -> DataFrame:
    """meeting_id, vec_id, label, person: the answers of ``label_meetings`` as numbers by first appearance (by win, local_label; -1: nobody's), and the speaker's id where one is known.

    atoms: meeting_id, vec_id, win, local_label. found: meeting_id, vec_id, person.
    """
    d = atoms.select("meeting_id", "vec_id", "win", "local_label").join(found, ["meeting_id", "vec_id"])
    first = d.filter("person IS NOT NULL").groupBy("meeting_id", "person").agg(F.min(F.struct("win", "local_label", "vec_id")).alias("_f"))
    numbered = first.withColumn("label", (F.row_number().over(Window.partitionBy("meeting_id").orderBy("_f")) - 1).cast("int")).drop("_f")
    known = F.when(F.startswith("person", F.lit("K")), F.substring("person", 2, 20).cast("long"))
    return d.join(numbered, ["meeting_id", "person"], "left").select("meeting_id", "vec_id", F.coalesce("label", F.lit(-1)).alias("label"), known.alias("person"))


def label_info(atoms: DataFrame, tagged: DataFrame) -> DataFrame:
    """meeting_id, k, named, unresolved, named_share: identities in a meeting, those with a name, atoms nobody holds, and the named share of its seconds."""
    d = atoms.select("meeting_id", "vec_id", "sec").join(tagged, ["meeting_id", "vec_id"])
    some = F.when(F.col("label") >= 0, F.col("label"))
    share = F.sum(F.when(F.col("person").isNotNull(), F.col("sec")).otherwise(0.0)) / F.sum("sec")
    return d.groupBy("meeting_id").agg(F.count_distinct(some).alias("k"), F.count_distinct(F.when(F.col("person").isNotNull(), F.col("label"))).alias("named"), F.count_if(F.col("label") < 0).alias("unresolved"), F.round(F.coalesce(share, F.lit(0.0)), 4).alias("named_share"))


def suggest_voices(voices: DataFrame, bank: DataFrame, top: int = 4, accept: float = DEFAULTS.accept) -> DataFrame:
    """meeting_id, tag, seconds, start, rank, person, sim, margin, over: whom each unresolved voice of a meeting may be.

    voices: meeting_id, vec_id, win, local_label, start, sec, v, person (as of
    ``label_meetings``). The atoms of one provisional identity (or of none:
    UNKNOWN) are pooled by seconds and held against everybody in the bank
    (person, v); the ``top`` people come with the lead of the first over the
    second (null with one person), and whether they reach ``accept``.
    """
    open_ = voices.filter("person IS NULL OR person NOT LIKE 'K%'").withColumn("tag", F.coalesce("person", F.lit("UNKNOWN")))
    about = open_.groupBy("meeting_id", "tag").agg(F.sum("sec").alias("seconds"), F.min("start").alias("start"))
    pooled = matching.pool(open_, "meeting_id", "tag", weight="sec").join(about, ["meeting_id", "tag"])
    near = pooled.crossJoin(matching.small_bank(bank.select(F.col("person").alias("who"), F.col("v").alias("bv"))))
    best = near.groupBy("meeting_id", "tag", "seconds", "start", "who").agg(F.max(dot(F.col("v"), F.col("bv"))).alias("sim"))
    by = Window.partitionBy("meeting_id", "tag").orderBy(F.desc("sim"), "who")
    d = best.withColumn("rank", F.row_number().over(by)).withColumn("_next", F.lead("sim").over(by))
    lead = F.max(F.when(F.col("rank") == 1, F.col("sim") - F.col("_next"))).over(Window.partitionBy("meeting_id", "tag"))
    return d.withColumn("margin", lead).filter(F.col("rank") <= top).select("meeting_id", "tag", "seconds", "start", "rank", F.col("who").alias("person"), "sim", "margin", (F.col("sim") >= accept).alias("over"))


def voice_samples(voices: DataFrame, segments: DataFrame, chars: int = 88) -> DataFrame:
    """meeting_id, tag, sample: what an unresolved voice said in the window where it is heard first."""
    open_ = voices.filter("person IS NULL OR person NOT LIKE 'K%'").withColumn("tag", F.coalesce("person", F.lit("UNKNOWN")))
    first = open_.groupBy("meeting_id", "tag").agg(F.min_by(F.struct("win", "local_label"), F.struct("start", "vec_id")).alias("x")).select("meeting_id", "tag", "x.win", "x.local_label")
    said = segments.join(first, ["meeting_id", "win", "local_label"]).groupBy("meeting_id", "tag").agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY seg_idx)").alias("t"))
    return said.select("meeting_id", "tag", F.trim(F.substring("t", 1, chars)).alias("sample"))


def suggest(atoms: DataFrame, bank: DataFrame, top: int = 4, p=DEFAULTS, rosters: DataFrame | None = None) -> DataFrame:
    """``suggest_voices`` of meetings that are named first. atoms: meeting_id, vec_id, win, local_label, label, sec, v; they start by vec_id. An empty bank is an error."""
    if bank.isEmpty():
        raise ValueError("nobody is enrolled yet")
    found = recovery.label_meetings(atoms, bank, p, rosters=rosters)
    voices = atoms.join(found, ["meeting_id", "vec_id"]).withColumn("start", F.col("vec_id"))
    return suggest_voices(voices, bank, top, p.accept)


def names_from_groups(store: Store) -> DataFrame:
    """meeting_id, gid, name: clusters whose group somebody has named."""
    g = store.groups.join(store.speakers.select(F.col("id").alias("speaker_id"), "name"), "speaker_id").select("group_id", "name")
    return store.clusters.join(g, "group_id").select("meeting_id", F.col("cluster").alias("gid"), "name")


def backfill(store: Store, segments: DataFrame, atoms: DataFrame | None, bank: DataFrame | None, p=DEFAULTS, rosters: DataFrame | None = None) -> tuple[DataFrame, DataFrame, Store]:
    """(changes, segments, store): what naming all meetings anew would change; nothing is written.

    Meetings with atoms are labelled from the bank by ``identity.relabel``;
    the others, or all if there is no bank, get the names of their clusters'
    groups. segments: meeting_id, win, local_label, gid, speaker_name, ...;
    changes: meeting_id, gid, before, after, change (gained, changed, lost).
    Without any named group there is nothing to write: an error.
    """
    if store.groups.filter("speaker_id IS NOT NULL").isEmpty():
        raise ValueError("no named groups in the store; link and name first")
    columns = segments.columns
    before = segments.filter("speaker_name IS NOT NULL").select("meeting_id", "gid", "speaker_name").distinct()
    new, rest, after = store, segments, None
    if atoms is not None and bank is not None:
        matched = segments.join(atoms.select("meeting_id").distinct(), "meeting_id", "left_semi")
        rest = segments.join(atoms.select("meeting_id").distinct(), "meeting_id", "left_anti")
        named, new = identity.relabel(store, matched.drop("gid", "speaker_name"), atoms, bank, p, rosters)
        people = store.speakers.select(F.col("id").alias("person"), F.col("name").alias("speaker_name"))
        after = named.join(people, "person", "left").select(columns)
    by_group = names_from_groups(store).withColumnRenamed("name", "speaker_name")
    kept = rest.drop("speaker_name").join(by_group, ["meeting_id", "gid"], "left").select(columns)
    after = settled(kept if after is None else after.unionByName(kept))
    key = lambda d: d.select(F.struct("meeting_id", "gid").alias("key"), F.col("speaker_name").alias("name"))
    now = after.filter("speaker_name IS NOT NULL").select("meeting_id", "gid", "speaker_name").distinct()
    diff = reports.name_diff(key(before), key(now)).select("key.meeting_id", "key.gid", "change")
    old = before.withColumnRenamed("speaker_name", "before")
    changes = diff.join(old, ["meeting_id", "gid"], "left").join(now.withColumnRenamed("speaker_name", "after"), ["meeting_id", "gid"], "left")
    return changes.select("meeting_id", "gid", "before", "after", "change"), after, new
