"""Linking clusters of all meetings into identities, writing the links to the store, and naming them."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import linking, matching, recovery, selection
from lodestrata.operators.clustering import factors, labels_at, linkage
from lodestrata.operators.store import Store, upsert_clusters
from lodestrata.params import DEFAULTS
from lodestrata.runtime import settled, ship


def linked(clusters: DataFrame, p=DEFAULTS, most: int = 5000) -> DataFrame:
    """id, link (the group's smallest id): average linkage cut at ``link_accept``, never with two clusters of a meeting in one group.

    An average that high needs a pair that high, so each component of the
    similar pairs is linked by itself, over all its pairs. A component of more
    than ``most`` clusters is an error: its matrix would outgrow a task.
    """
    label = [c for c in ("label",) if c in clusters.columns]
    near = linking.similar_groups(clusters.select("id", *label, "v"), p.link_accept).select(F.col("node").alias("id"), F.col("label").alias("comp"))
    d = clusters.select("id", "meeting_id", *label, "v").join(near, "id")
    if not d.groupBy("comp").count().filter(F.col("count") > most).isEmpty():
        raise ValueError(f"more than {most} clusters hang together; raise link_accept")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        v, meeting = np.stack(g.v.to_numpy()), g.meeting_id.to_numpy()
        x = factors(g.label.to_numpy(), v) if label else v
        labels = labels_at(len(g), linkage((x, x), (meeting[:, None] == meeting[None, :]) & ~np.eye(len(g), dtype=bool)), p.link_accept)
        ids = g.id.to_numpy()
        return pd.DataFrame({"id": ids, "link": [ids[labels == x].min() for x in labels]})

    ship(clusters.sparkSession)
    found = d.groupBy("comp").applyInPandas(run, "id long, link long")
    return clusters.select("id").join(found, "id", "left").select("id", F.coalesce("link", "id").alias("link"))


def link_groups(clusters: DataFrame, bank: DataFrame, p=DEFAULTS) -> DataFrame:
    """id, meeting_id, seconds, grp (the identity's smallest cluster id), speaker_id (null: unknown), how (named, claimed, inherited, linked).

    clusters: id, meeting_id, v (unit), seconds, speaker_id (of its present
    group), and label where similarity is blended with one; those under
    ``min_link_sec`` seconds take no part. bank: person (a speaker's id), v.

    * named: what was named together stays together.
    * claimed: bank and clusters are matched at ``accept``, strongest first,
      one cluster of a meeting for a person.
    * inherited: a linked group goes to the person who has at least
      ``name_inherit_share`` of its seconds (ties: the larger id), but for
      meetings in which the person has a cluster already; of several that
      could follow in a meeting the longest does.
    * linked: all others are groups by linkage alone.
    """
    c = settled(clusters.filter(F.col("seconds") >= p.min_link_sec))
    scored = matching.scores(c.select(F.col("id").alias("vec_id"), "meeting_id", F.lit(0).alias("win"), *(x for x in ("label",) if x in c.columns), "v"), bank)
    held = c.filter("speaker_id is not null").select("meeting_id", F.col("speaker_id").alias("person")).distinct()
    free = scored.join(c.filter("speaker_id is null").select(F.col("id").alias("vec_id")), "vec_id", "left_semi").withColumn("person", F.col("person").cast("long")).join(held, ["meeting_id", "person"], "left_anti")
    claims = matching.one_to_one(free, p.accept).select(F.col("vec_id").alias("id"), F.col("person").alias("claimed"))
    d = c.join(linked(c, p), "id").join(claims, "id", "left").withColumn("sure", F.coalesce("speaker_id", "claimed"))
    share = d.groupBy("link", "sure").agg(F.sum("seconds").alias("s"))
    share = share.withColumn("all", F.sum("s").over(Window.partitionBy("link"))).filter("sure is not null").withColumn("k", F.row_number().over(Window.partitionBy("link").orderBy(F.desc("s"), F.desc("sure"))))
    heir = share.filter((F.col("k") == 1) & (F.col("s") >= p.name_inherit_share * F.col("all"))).select("link", F.col("sure").alias("heir"))
    taken = d.filter("sure is not null").select("meeting_id", F.col("sure").alias("heir")).distinct()
    follows = d.filter("sure is null").join(heir, "link").join(taken, ["meeting_id", "heir"], "left_anti")
    follows = follows.withColumn("k", F.row_number().over(Window.partitionBy("meeting_id", "heir").orderBy(F.desc("seconds"), "id"))).filter("k = 1").select("id", "heir")
    d = d.join(follows, "id", "left").withColumn("who", F.coalesce("sure", "heir"))
    how = F.when(F.col("speaker_id").isNotNull(), "named").when(F.col("claimed").isNotNull(), "claimed").when(F.col("heir").isNotNull(), "inherited").otherwise("linked")
    d = d.select("id", "meeting_id", "seconds", F.col("who").alias("speaker_id"), how.alias("how"), F.when(F.col("who").isNull(), F.col("link")).alias("link"))
    return settled(d.withColumn("grp", F.min("id").over(Window.partitionBy("speaker_id", "link"))).select("id", "meeting_id", "seconds", "grp", "speaker_id", "how"))


def link_conflicts(groups: DataFrame) -> DataFrame:
    """meeting_id, grp, n: identities with several clusters in a meeting. Only names given by hand can cause one."""
    return groups.groupBy("meeting_id", "grp").agg(F.count("*").alias("n")).filter("n > 1")


def link_apply(store: Store, groups: DataFrame) -> Store:
    """The links written to the store, whose clusters have an id.

    Groups without a speaker are dropped; a speaker's smallest group is used
    again; new groups get ids above all that were ever used. Clusters that
    took no part keep a named group and lose an unnamed one. A dry run is not
    to call this.
    """
    own = store.groups.filter("speaker_id is not null").groupBy("speaker_id").agg(F.min("group_id").alias("known"))
    high = store.groups.agg(F.coalesce(F.max("group_id"), F.lit(0)).alias("high"))
    g = groups.join(own, "speaker_id", "left").join(F.broadcast(high)).withColumn("new", F.coalesce("known", F.col("high") + 1 + F.col("grp")))
    made = g.select(F.col("new").alias("group_id"), "speaker_id").distinct()
    kept = store.groups.filter("speaker_id is not null").select("group_id", "speaker_id")
    c = store.clusters.join(g.select("id", "new"), "id", "left").join(kept.select("group_id", F.lit(True).alias("stays")), "group_id", "left")
    c = c.withColumn("group_id", F.coalesce("new", F.when(F.col("stays"), F.col("group_id")))).select(store.clusters.columns)
    return replace(store, groups=settled(kept.unionByName(made).distinct()), clusters=settled(c))


def relabel(store: Store, segments: DataFrame, atoms: DataFrame, bank: DataFrame, p=DEFAULTS, rosters: DataFrame | None = None) -> tuple[DataFrame, Store]:
    """Whole meetings labelled anew from the bank: their segments, and the store with their clusters.

    segments: meeting_id, win, local_label; they get ``gid`` (G00, G01, ... by
    the voice's first atom; null: nobody's) and ``person`` (null: unknown).
    atoms: meeting_id, vec_id, win, local_label, label, sec, v, n_segments;
    an atom whose n_segments isn't the number of its segments is an error.
    Clusters are the seconds-weighted units by meeting and gid; one that is
    in no group goes to its person's smallest group. Other meetings stay.
    rosters: see ``recovery.label_meetings``.
    """
    found = recovery.label_meetings(atoms, bank, p, rosters=rosters).filter("person is not null").withColumnRenamed("person", "_who")
    d = atoms.join(found, ["meeting_id", "vec_id"])
    voices = d.groupBy("meeting_id", "_who").agg(F.min(F.struct("win", "vec_id")).alias("_first"), F.sum("sec").alias("seconds"))
    k = F.row_number().over(Window.partitionBy("meeting_id").orderBy("_first")) - 1
    person = F.when(F.startswith("_who", F.lit("K")), F.substring("_who", 2, 20).cast("long"))
    voices = settled(voices.select("meeting_id", "_who", "seconds", F.concat(F.lit("G"), F.lpad(k.cast("string"), 2, "0")).alias("gid"), person.alias("person")))
    d = settled(d.join(voices.drop("seconds"), ["meeting_id", "_who"]))
    named = selection.labels_to_segments(segments.drop("gid", "person", "label"), d.select("meeting_id", "win", "local_label", F.struct("gid", "person").alias("label"), "n_segments"))
    named = named.select("*", "label.gid", "label.person").drop("label")
    centres = matching.pool(d, "meeting_id", "gid", weight="sec")
    new = voices.join(centres, ["meeting_id", "gid"]).select("meeting_id", F.col("gid").alias("cluster"), "seconds", "v", F.xxhash64("v").cast("string").alias("digest"), "person")
    own = store.groups.filter("speaker_id is not null").groupBy(F.col("speaker_id").alias("person")).agg(F.min("group_id").alias("_own"))
    merged = upsert_clusters(store.clusters, new).join(own, "person", "left").withColumn("group_id", F.coalesce("group_id", "_own")).drop("_own", "person")
    return named, replace(store, clusters=settled(merged))
