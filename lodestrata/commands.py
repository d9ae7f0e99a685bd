"""What a user does with a store on disk: every command opens its last version, and those that change something commit the next.

Reports are DataFrames in the order they are read in. Commands that decide
much (``link``, ``apply``) are dry runs unless told to apply.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import bar
from lodestrata.operators import identity, naming, profiles, reports, selection
from lodestrata.operators import store as statements
from lodestrata.operators.store import Store
from lodestrata.params import DEFAULTS
from lodestrata.sources import acks, versions


def _open(spark: SparkSession, path: str) -> Store:
    return versions.open_store(spark, path)[0]


def _bank(store: Store, model: str | None = None, names: list[str] | None = None) -> DataFrame:
    spark = store.speakers.sparkSession
    roster = spark.createDataFrame([(n,) for n in names], "name string") if names else None
    return selection.named_bank(store.exemplars, store.speakers, model, roster)


def _speaker(store: Store, who: int | str) -> int:
    """A speaker by id, or by name."""
    found = store.speakers.filter(F.col("id") == who if isinstance(who, int) else F.col("name") == who).select("id").first()
    if found is None:
        raise ValueError(f"no speaker {who}")
    return found["id"]


def index(spark: SparkSession, path: str, clusters: DataFrame) -> versions.Version:
    """Clusters of decoded meetings (meeting_id, cluster, v, seconds) into the store; see ``store.upsert_clusters``. New ones get ids above all there are."""

    def change(store: Store) -> Store:
        new = clusters.select(F.col("meeting_id").cast("string").alias("meeting_id"), "cluster", "v", "seconds", F.sha2(F.to_json("v"), 256).alias("digest"))
        merged = statements.upsert_clusters(store.clusters, new)
        old = store.clusters.select("meeting_id", "cluster", F.col("id").alias("_id"))
        high = store.clusters.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_high"))  # one row
        kept = merged.drop("id").join(old, ["meeting_id", "cluster"], "left").join(F.broadcast(high), how="cross")
        return replace(store, clusters=kept.withColumn("id", F.coalesce("_id", F.col("_high") + 1 + F.monotonically_increasing_id())).drop("_id", "_high"))

    return versions.transact(spark, path, change, changed=("clusters",))


def link(spark: SparkSession, path: str, apply: bool = False, threshold: float = DEFAULTS.link_accept, min_sec: float = DEFAULTS.min_link_sec, model: str | None = None) -> DataFrame:
    """id, meeting_id, seconds, grp, speaker_id, how: which clusters are one voice. With ``apply`` the links are written and every named person's profiles drawn anew."""
    p = replace(DEFAULTS, link_accept=threshold, min_link_sec=min_sec)

    def found(store: Store) -> DataFrame:
        c = selection.of_model(store.clusters, model).join(store.groups.select("group_id", "speaker_id"), "group_id", "left")
        return identity.link_groups(c.select("id", "meeting_id", "v", "seconds", "speaker_id"), _bank(store, model).select("person", "v"), p)

    if not apply:
        return found(_open(spark, path))
    done: list[DataFrame] = []

    def change(store: Store) -> Store:
        done[:] = [found(store)]
        return profiles.refresh(identity.link_apply(store, done[0]), p)

    versions.transact(spark, path, change, changed=("groups", "clusters", "exemplars"))
    return done[0]


def name(spark: SparkSession, path: str, group: int, name: str | None = None, speaker: int | None = None, condition: str | None = None, new: bool = False) -> versions.Version:
    return versions.transact(spark, path, lambda s: naming.name_group(s, group, name, speaker, condition, near_ok=new), changed=("speakers", "groups", "exemplars"))


def groups(spark: SparkSession, path: str) -> DataFrame:
    s = _open(spark, path)
    return reports.group_report(s.groups, s.clusters, s.speakers.select("id", "name")).orderBy(F.desc("meetings"), F.desc("n_clusters"), "group_id")


def speakers(spark: SparkSession, path: str) -> DataFrame:
    s = _open(spark, path)
    return reports.speaker_list(s.speakers.select("id", "name"), s.exemplars).orderBy("name")


def review(spark: SparkSession, path: str, limit: int = 15, min_sec: float = DEFAULTS.min_link_sec, samples: DataFrame | None = None) -> DataFrame:
    """The unnamed groups most worth a name, with what they said where ``samples`` (meeting_id, cluster, sample) tell."""
    s = _open(spark, path)
    queue = reports.review_queue(s.clusters, s.groups.select("group_id", "speaker_id"), min_sec, limit)
    if samples is None:
        return queue
    said = profiles.group_samples(s.clusters, samples)
    return queue.join(said, "group_id", "left").orderBy(F.desc("meetings"), F.desc("seconds"), "group_id")


def profiles_of(spark: SparkSession, path: str, who: int | str, show: int = 5) -> DataFrame:
    """condition, seconds, n, auto, rank, meeting_id, cluster, member_seconds, fit: a person's profiles, longest first, each with its ``show`` longest clusters and how well they fit; a profile without clusters has one row."""
    from pyspark.sql import Window

    s = _open(spark, path)
    sid = _speaker(s, who)
    own = s.exemplars.filter(F.col("speaker_id") == sid)
    m = profiles.membership(profiles.members_of(s).filter(F.col("speaker_id") == sid), own).select("id", "condition", F.col("sim").alias("fit"))
    m = m.join(s.clusters.select("id", "meeting_id", "cluster", F.col("seconds").alias("member_seconds")), "id")
    w = Window.partitionBy("condition")
    m = m.withColumn("n", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("member_seconds"), "id"))).filter(F.col("rank") <= show)
    d = own.select("condition", "seconds").join(m, "condition", "left")
    auto = F.startswith("condition", F.lit("auto-"))
    return d.select("condition", "seconds", F.coalesce("n", F.lit(0)).alias("n"), auto.alias("auto"), "rank", "meeting_id", "cluster", "member_seconds", "fit").orderBy(F.desc("seconds"), "condition", "rank")


def suspects(spark: SparkSession, path: str, who: int | str, below: float = 0.5, min_sec: float = DEFAULTS.min_link_sec) -> DataFrame:
    """speaker_id, id, seconds, condition, sim: clusters of a person that fit none of their profiles, the worst first."""
    s = _open(spark, path)
    sid = _speaker(s, who)
    return selection.weak_suspects(profiles.membership(profiles.members_of(s).filter(F.col("speaker_id") == sid), s.exemplars), below, min_sec)


def _exemplars(spark: SparkSession, path: str, who: int | str, change) -> versions.Version:
    def new(s: Store) -> Store:
        return replace(s, exemplars=change(s, _speaker(s, who)))

    return versions.transact(spark, path, new, changed=("exemplars",))


def profile_rename(spark: SparkSession, path: str, who: int | str, old: str, new: str) -> versions.Version:
    return _exemplars(spark, path, who, lambda s, sid: profiles.rename_profile(s.exemplars, sid, old, new))


def profile_merge(spark: SparkSession, path: str, who: int | str, first: str, second: str, as_name: str | None = None) -> versions.Version:
    return _exemplars(spark, path, who, lambda s, sid: profiles.merge_profiles(s.exemplars, sid, first, second, as_name))


def profile_split(spark: SparkSession, path: str, who: int | str, condition: str, into: int = 2, cover: float = 0.86) -> versions.Version:
    return _exemplars(spark, path, who, lambda s, sid: profiles.split_profile(profiles.members_of(s), s.exemplars, sid, condition, into, cover))


def suggest(spark: SparkSession, path: str, atoms: DataFrame, top: int = 4, roster: list[str] | None = None) -> DataFrame:
    """Whom the unresolved voices of meetings may be (see ``naming.suggest``), with names and bars, the longest voice first."""
    s = _open(spark, path)
    got = naming.suggest(atoms, _bank(s, names=roster).select("person", "v"), top)
    people = s.speakers.select(F.col("id").alias("person"), "name")
    return got.join(people, "person", "left").withColumn("bar", bar(F.col("sim"))).orderBy("meeting_id", F.desc("seconds"), "tag", "rank")


def rename(spark: SparkSession, path: str, speaker: int, name: str) -> versions.Version:
    return versions.transact(spark, path, lambda s: statements.rename_speaker(s, speaker, name), changed=("speakers",))


def forget(spark: SparkSession, path: str, speaker: int) -> versions.Version:
    return versions.transact(spark, path, lambda s: statements.forget_speaker(s, _speaker(s, speaker)), changed=("speakers", "groups", "exemplars"))


def apply(spark: SparkSession, path: str, segments: DataFrame, atoms: DataFrame | None = None, meetings: DataFrame | None = None, out: str | None = None, apply: bool = False, roster: list[str] | None = None, rosters: DataFrame | None = None, from_groups: bool = False) -> DataFrame:
    """What naming the meetings anew changes (see ``naming.backfill``). With ``apply`` the store is committed, and if ``out`` is given, the transcripts of the changed ``meetings`` (meeting_id, title, duration) are written there, acknowledged one by one."""
    s, at = versions.open_store(spark, path)
    bank = None if from_groups else _bank(s, names=roster).select("person", "v")
    changes, after, new = naming.backfill(s, segments, None if from_groups else atoms, bank, rosters=rosters)
    if apply:
        if out is not None and meetings is not None:
            names = after.filter("speaker_name IS NOT NULL").select("meeting_id", "gid", F.col("speaker_name").alias("name")).distinct()
            changed = changes.select("meeting_id").distinct()
            texts = reports.render_transcripts(after.join(changed, "meeting_id", "left_semi"), meetings, names)
            acks.publish(texts.select(F.col("meeting_id").cast("string").alias("output"), F.col("text").alias("value")), f"{out}/transcripts", f"{out}/acks")
        if new is not s:
            versions.commit(new, path, at, changed=("clusters",))
    return changes
