"""A person's profiles: one exemplar for each circumstance in which a voice is known.

``members`` are a person's clusters over all meetings: speaker_id, id (unique),
seconds, v. All persons are worked on at once, in rounds of joins and partial
aggregates, so one whom most meetings hold is no single task.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import fold
from lodestrata.functions.vectors import dot, unit
from lodestrata.operators import identity
from lodestrata.operators.matching import pool
from lodestrata.operators.store import Store, near_names, pool_exemplars
from lodestrata.params import DEFAULTS
from lodestrata.runtime import settled, ship


def members_of(store: Store) -> DataFrame:
    """speaker_id, id, seconds, v: the named clusters that hold speech."""
    named = store.groups.filter("speaker_id is not null").select("group_id", "speaker_id")
    return store.clusters.filter("seconds > 0").join(named, "group_id").select("speaker_id", "id", "seconds", "v")


def cover_members(members: DataFrame, reach: float = DEFAULTS.cover, most: int = DEFAULTS.max_profiles) -> DataFrame:
    """speaker_id, id, seconds, v (unit), near, owner, pick: the covering set and who belongs to whom.

    The longest member is picked first, then always the one least similar to
    all picks, until each is within ``reach`` of one or ``most`` are picked
    (ties: the smaller id). ``pick`` is the round in which a member was picked
    (null: not), ``owner`` that of its most similar pick (ties: the earlier).
    """
    state = settled(members.select("speaker_id", "id", "seconds", unit(F.col("v")).alias("v"), F.lit(-2.0).alias("near"), F.lit(0).alias("owner"), F.lit(None).cast("int").alias("pick")))
    picked = state.groupBy("speaker_id").agg(F.min(F.struct((-F.col("seconds")).alias("m"), "id", "v")).alias("x"))
    done = []
    for k in range(1, most + 1):
        picked = settled(picked.select("speaker_id", F.col("x.id").alias("_id"), F.col("x.v").alias("_v")))
        if picked.isEmpty():
            break
        if k > 1:
            done.append(state.join(picked.select("speaker_id"), "speaker_id", "left_anti"))
        sim = dot(F.col("v"), F.col("_v"))
        j = state.join(picked, "speaker_id").withColumn("_s", sim)
        state = settled(j.select("speaker_id", "id", "seconds", "v", F.greatest("near", "_s").alias("near"), F.when(F.col("_s") > F.col("near"), k).otherwise(F.col("owner")).alias("owner"), F.when(F.col("id") == F.col("_id"), k).otherwise(F.col("pick")).alias("pick")))
        picked = state.filter("pick is null").groupBy("speaker_id").agg(F.min(F.struct(F.col("near").alias("m"), "id", "v")).alias("x")).filter(F.col("x.m") < reach)
    return reduce(DataFrame.unionByName, [*done, state])


def _known(exemplars: DataFrame) -> DataFrame:
    """speaker_id, _ex: a person's exemplars in one array, longest first; one for each condition."""
    one = F.struct((-F.col("seconds")).alias("m"), "condition", unit(F.col("v")).alias("v"))
    return exemplars.groupBy("speaker_id").agg(F.sort_array(F.collect_list(one)).alias("_ex"))


def membership(members: DataFrame, exemplars: DataFrame) -> DataFrame:
    """speaker_id, id, seconds, condition, sim: the person's exemplar that each member is nearest to (ties: the longer); members of persons without one are left out."""
    best = F.array_max(F.transform("_ex", lambda e, i: F.struct(dot(unit(F.col("v")), e["v"]).alias("sim"), (-i).alias("i"))))
    j = members.join(_known(exemplars), "speaker_id").withColumn("_b", best)
    return j.select("speaker_id", "id", "seconds", F.element_at("_ex", 1 - F.col("_b.i"))["condition"].alias("condition"), F.col("_b.sim").alias("sim"))


def agreement(vectors: DataFrame, least: float, block: int = 2048) -> DataFrame:
    """id, agree: how many others of the same speaker_id reach ``least``. Blocks are multiplied in tasks of their own; counts leave them, pairs don't."""
    size = vectors.groupBy("speaker_id").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_k"))
    cell = vectors.select("speaker_id", "id", unit(F.col("v")).alias("v")).join(size, "speaker_id").withColumn("cell", F.pmod(F.xxhash64("id"), F.col("_k")).cast("int"))
    left = cell.withColumn("other", F.explode(F.expr("sequence(cell, _k - 1)"))).select("speaker_id", "id", "v", F.col("cell").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"))
    right = cell.withColumn("other", F.explode(F.expr("sequence(0, cell)"))).select("speaker_id", "id", "v", F.col("other").alias("i"), F.col("cell").alias("j"), F.lit(1).alias("side"))

    def product(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g[g.side == 0], g[g.side == 1]
        if not len(x) or not len(y):
            return pd.DataFrame({"id": np.zeros(0, int), "n": np.zeros(0, int)})
        hit = np.stack(x.v.to_numpy()) @ np.stack(y.v.to_numpy()).T >= least
        rows = [(x.id.to_numpy(), hit.sum(axis=1))]
        if int(g.i.iloc[0]) == int(g.j.iloc[0]):
            own = x.id.to_numpy()[:, None] == y.id.to_numpy()[None, :]
            rows = [(x.id.to_numpy(), (hit & ~own).sum(axis=1))]
        else:
            rows.append((y.id.to_numpy(), hit.sum(axis=0)))
        return pd.DataFrame({"id": np.concatenate([r[0] for r in rows]), "n": np.concatenate([r[1] for r in rows])})

    ship(vectors.sparkSession)
    counts = left.unionByName(right).groupBy("speaker_id", "i", "j").applyInPandas(product, "id long, n long")
    return counts.groupBy("id").agg(F.sum("n").alias("agree"))


def confident(members: DataFrame, exemplars: DataFrame, keep: float = DEFAULTS.keep_exemplar, least: int = DEFAULTS.min_corroboration) -> DataFrame:
    """The members that may shape their person's profiles.

    Those within ``keep`` of a known exemplar; and of the others, where there
    are at least ``least``, those that agree with ``least`` - 1 more of them.
    A person without exemplars, or of whom none would be left, keeps all.
    """
    near = F.exists("_ex", lambda e: dot(unit(F.col("v")), e["v"]) >= keep)
    d = settled(members.join(_known(exemplars), "speaker_id", "left").select(*members.columns, F.when(F.col("_ex").isNull(), True).otherwise(near).alias("_near")))
    far = d.filter(~F.col("_near"))
    many = far.groupBy("speaker_id").count().filter(F.col("count") >= least).select("speaker_id")
    sure = agreement(far.join(many, "speaker_id", "left_semi"), keep).filter(F.col("agree") >= least - 1).select("id", F.lit(True).alias("_sure"))
    d = settled(d.join(sure, "id", "left").withColumn("_vote", F.col("_near") | F.coalesce("_sure", F.lit(False))))
    any_vote = d.groupBy("speaker_id").agg(F.max("_vote").alias("_any"))
    return d.join(any_vote, "speaker_id").filter(F.col("_vote") | ~F.col("_any")).select(members.columns)


def _pooled(owned: DataFrame, condition: Column) -> DataFrame:
    d = owned.select("speaker_id", condition.alias("condition"), "v", "seconds")
    sums = d.groupBy("speaker_id", "condition").agg(F.sum("seconds").alias("seconds"))
    return pool(d, "speaker_id", "condition", weight="seconds").join(sums, ["speaker_id", "condition"]).select("speaker_id", "condition", "v", "seconds")


def refresh(store: Store, p=DEFAULTS) -> Store:
    """Each named person's ``auto-`` exemplars drawn anew: a covering set of the confident members, each pooled into its nearest pick. Exemplars with a name given by hand stay, as do those of persons without members."""
    old = store.exemplars.select("speaker_id", "condition", "v", "seconds")
    owned = cover_members(confident(members_of(store), old, p.keep_exemplar, p.min_corroboration), p.cover, p.max_profiles)
    new = settled(_pooled(owned, F.concat(F.lit("auto-"), F.col("owner").cast("string"))))
    redrawn = new.select("speaker_id").distinct().withColumn("_new", F.lit(True))
    kept = old.join(redrawn, "speaker_id", "left").filter(F.col("_new").isNull() | ~F.startswith("condition", F.lit("auto-"))).drop("_new")
    return replace(store, exemplars=kept.unionByName(new))


def self_train(store: Store, rounds: int = 3, p=DEFAULTS) -> Store:
    """Link, write the links, draw the profiles anew, and again: each round reaches what the last one's profiles taught. Ends when no cluster's person changes. Clusters carry id, meeting_id, label, v, seconds."""
    who = lambda s: s.clusters.join(s.groups, "group_id", "left").select("id", "speaker_id")
    for _ in range(rounds):
        before = settled(who(store))
        c = store.clusters.join(store.groups.select("group_id", "speaker_id"), "group_id", "left").select("id", "meeting_id", "label", "v", "seconds", "speaker_id")
        store = identity.link_apply(store, identity.link_groups(c, store.exemplars.select(F.col("speaker_id").alias("person"), "v"), p))
        store = refresh(store, p)
        after = who(store).withColumnRenamed("speaker_id", "now")
        if before.join(after, "id").filter(~F.col("speaker_id").eqNullSafe(F.col("now"))).isEmpty():
            break
    return store


def _conditions(exemplars: DataFrame, speaker_id: int, *names: str) -> dict[str, float]:
    """Seconds of the named exemplars; one that is missing is an error."""
    rows = exemplars.filter((F.col("speaker_id") == speaker_id) & F.col("condition").isin(*names)).select("condition", "seconds").collect()
    found = {r["condition"]: r["seconds"] or 1.0 for r in rows}
    for n in names:
        if n not in found:
            raise ValueError(f"speaker {speaker_id} has no profile {n}")
    return found


def merge_profiles(exemplars: DataFrame, speaker_id: int, first: str, second: str, as_name: str | None = None) -> DataFrame:
    """Two profiles become one, weighted by seconds. Its name: ``as_name``, else the one given by hand, else that of the longer (of equals the first)."""
    if first == second:
        raise ValueError("a profile can't be merged with itself")
    sec = _conditions(exemplars, speaker_id, first, second)
    auto = {n: n.startswith("auto-") for n in (first, second)}
    if auto[first] != auto[second]:
        name = second if auto[first] else first
    else:
        name = first if sec[first] >= sec[second] else second
    both = (F.col("speaker_id") == speaker_id) & F.col("condition").isin(first, second)
    e = exemplars.select("speaker_id", "condition", "v", "seconds")
    half = e.filter(both).select("speaker_id", F.lit(as_name or name).alias("condition"), unit(F.col("v")).alias("v"), F.when(F.col("seconds") > 0, F.col("seconds")).otherwise(1.0).alias("seconds"))
    return pool_exemplars(e.filter(~both), half)


def rename_profile(exemplars: DataFrame, speaker_id: int, old: str, new: str) -> DataFrame:
    """A profile under a name given by hand, which no later refresh redraws; a name that another profile has is refused."""
    _conditions(exemplars, speaker_id, old)
    mine = F.col("speaker_id") == speaker_id
    if old != new and not exemplars.filter(mine & (F.col("condition") == new)).isEmpty():
        raise ValueError(f"speaker {speaker_id} has a profile {new}")
    return exemplars.withColumn("condition", F.when(mine & (F.col("condition") == old), F.lit(new)).otherwise(F.col("condition")))


def split_profile(members: DataFrame, exemplars: DataFrame, speaker_id: int, condition: str, into: int = 4, reach: float = 0.86, least: float = DEFAULTS.min_enroll_sec) -> DataFrame:
    """The exemplars with one profile replaced by up to ``into``, each a pick of the covering set of its members.

    Parts under ``least`` seconds go, the first pick's first, and their members
    move to the nearest pick left. New names count on from the person's
    highest ``auto-`` number. An error if fewer than two parts are left.
    """
    _conditions(exemplars, speaker_id, condition)
    own = membership(members.filter(F.col("speaker_id") == speaker_id), exemplars.filter(F.col("speaker_id") == speaker_id))
    mine = members.join(own.filter(F.col("condition") == condition).select("id"), "id", "left_semi")
    d = settled(cover_members(mine, reach, into))
    picks = d.filter("pick is not null").select("pick", "v").orderBy("pick").collect()  # at most ``into`` rows
    owner, kept = F.col("owner"), [r["pick"] for r in picks]
    vectors = {r["pick"]: F.array(*(F.lit(float(x)) for x in r["v"])) for r in picks}
    for _ in range(len(picks)):
        sums = {r["o"]: r["s"] for r in d.groupBy(owner.alias("o")).agg(F.sum("seconds").alias("s")).collect()}
        tiny = [k for k in kept if sums.get(k, 0.0) < least]
        if not tiny or len(tiny) == len(kept):
            break
        kept.remove(tiny[0])
        best = F.array_max(F.array(*(F.struct(dot(F.col("v"), vectors[k]).alias("s"), F.lit(-k).alias("k")) for k in kept)))
        owner = F.when(owner == tiny[0], -best["k"]).otherwise(owner)
    if len(kept) < 2:
        raise ValueError(f"profile {condition} doesn't split")
    number = F.regexp_extract("condition", r"^auto-.*?(\d+)$", 1)
    high = exemplars.filter(F.col("speaker_id") == speaker_id).agg(F.max(F.when(number != "", number.cast("int")))).first()[0] or 0
    names = F.create_map(*(x for i, k in enumerate(kept) for x in (F.lit(k), F.lit(f"auto-{high + 1 + i}"))))
    parts = _pooled(d, F.element_at(names, owner))
    e = exemplars.select("speaker_id", "condition", "v", "seconds")
    return e.filter(~((F.col("speaker_id") == speaker_id) & (F.col("condition") == condition))).unionByName(parts)


def group_samples(clusters: DataFrame, samples: DataFrame, top: int = 3) -> DataFrame:
    """group_id, sample: what the longest of a group's ``top`` longest clusters said that has a sample (meeting_id, cluster, sample), as ``reports.text_samples`` takes them."""
    order = Window.partitionBy("group_id").orderBy(F.desc("seconds"), "meeting_id", "cluster")
    firsts = clusters.filter("group_id is not null").select("group_id", "meeting_id", "cluster", F.row_number().over(order).alias("m")).filter(F.col("m") <= top)  # WindowGroupLimit before the shuffle
    j = firsts.join(samples, ["meeting_id", "cluster"])
    return j.groupBy("group_id").agg(F.min_by("sample", "m").alias("sample"))


def closest_names(store: Store, names: DataFrame, n: int = 5, edits: int = DEFAULTS.near_name_edits) -> DataFrame:
    """a_name, b_name, rank: the first ``n`` speakers whose name is near to each of ``names``: equal ones once folded, then by name."""
    d = near_names(names, store.speakers.select("name"), edits)
    order = Window.partitionBy("a_name").orderBy((fold(F.col("a_name")) != fold(F.col("b_name"))).cast("int"), "b_name")
    return d.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
