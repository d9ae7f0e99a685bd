"""Pooling vectors and naming voices from a bank of known people."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.vectors import blended, dot, unit
from lodestrata.params import DEFAULTS
from lodestrata.runtime import ship


def pool(vectors: DataFrame, *keys: str, weight: str | None = None) -> DataFrame:
    """keys, v: the unit vector of the (weighted) mean by key."""
    w = F.col(weight) if weight else F.lit(1.0)
    e = vectors.select(*keys, w.alias("_w"), F.posexplode("v").alias("_i", "_x")).groupBy(*keys, "_i").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_x"))
    return e.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_p")).select(*keys, unit(F.transform("_p", lambda p: p["_x"])).alias("v"))


def small_bank(bank: DataFrame, most: int = 20_000) -> DataFrame:
    """The bank, marked for broadcast after a check of its size; a larger one must be named by roster first."""
    if bank.limit(most + 1).count() > most:
        raise ValueError("the bank is larger than may be broadcast; restrict it to a roster")
    return F.broadcast(bank)


def scores(atoms: DataFrame, bank: DataFrame, most_people: int = 20_000) -> DataFrame:
    """vec_id, person, sim: an atom's best similarity to each person; by the vectors alone if atoms have no label. The bank is broadcast, up to ``most_people`` exemplars."""
    b = small_bank(bank.select("person", F.col("v").alias("bv")), most_people)
    s = atoms.crossJoin(b).withColumn("sim", blended(F.col("label") == F.col("person"), F.col("v"), F.col("bv")) if "label" in atoms.columns else dot(F.col("v"), F.col("bv")))
    return s.groupBy(*(c for c in atoms.columns if c not in ("v",)), "person").agg(F.max("sim").alias("sim"))


def pool_atoms(segments: DataFrame, vectors: DataFrame) -> DataFrame:
    """meeting_id, win, local_label, v, sec, start, n: a voice of a window from its segments that have a vector: the unit of their mean, their seconds, where the first starts (by seg_idx), how many. Callers order by start.

    segments: meeting_id, seg_idx, win, local_label, start_s, end_s. vectors: meeting_id, seg_idx, v.
    """
    key = ["meeting_id", "win", "local_label"]
    j = segments.select(*key, "seg_idx", "start_s", "end_s").join(vectors.select("meeting_id", "seg_idx", "v"), ["meeting_id", "seg_idx"])
    about = j.groupBy(*key).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("sec"), F.min_by("start_s", "seg_idx").alias("start"), F.count("*").alias("n"))
    return pool(j, *key).join(about, key).select(*key, "v", "sec", "start", "n")


def named_share(scored: DataFrame, accept: float = DEFAULTS.accept) -> DataFrame:
    """meeting_id, n_atoms, named_share: share of the seconds whose best person reaches ``accept``."""
    best = scored.groupBy("meeting_id", "vec_id", "sec").agg(F.max("sim").alias("s"))
    return best.groupBy("meeting_id").agg(F.count("*").alias("n_atoms"), F.round(F.sum(F.when(F.col("s") >= accept, F.col("sec")).otherwise(0.0)) / F.sum("sec"), 4).alias("named_share"))


def one_to_one(scored: DataFrame, accept: float = DEFAULTS.accept) -> DataFrame:
    """meeting_id, vec_id, person, sim: within a window no person twice, strongest claims first (ties: the smaller vec_id, then person).

    Both sides rank by one score, so taking the strongest claim whose sides
    are both free, again and again, gives the stable matching. A window's
    claims are few: those of its own voices on people they resemble.
    """

    def claim(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["sim", "vec_id", "person"], ascending=[False, True, True])
        atoms, people, take = set(), set(), []
        for at, (v, p) in enumerate(zip(g.vec_id, g.person, strict=True)):
            if v not in atoms and p not in people:
                atoms.add(v)
                people.add(p)
                take.append(at)
        return g.iloc[take][["meeting_id", "vec_id", "person", "sim"]]

    ship(scored.sparkSession)
    kinds = dict(scored.dtypes)
    claims = scored.filter(F.col("sim") >= accept).select("meeting_id", "win", "vec_id", "person", "sim")
    return claims.groupBy("meeting_id", "win").applyInPandas(claim, ", ".join(f"{c} {kinds[c]}" for c in ("meeting_id", "vec_id", "person", "sim")))


def margins(scored: DataFrame) -> DataFrame:
    """vec_id, person, sim, margin: the best person, and by how much it beats the next; null with one."""
    by = Window.partitionBy("vec_id").orderBy(F.desc("sim"), "person")
    d = scored.withColumn("k", F.row_number().over(by)).withColumn("next", F.lead("sim").over(by))
    return d.filter("k = 1").select("vec_id", "person", "sim", (F.col("sim") - F.col("next")).alias("margin"))


def top_people(scored: DataFrame, n: int = 4) -> DataFrame:
    by = Window.partitionBy("vec_id").orderBy(F.desc("sim"), "person")
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def nearest(points: DataFrame, centres: DataFrame, most_centres: int = 20_000) -> DataFrame:
    """vec_id, centre, sim: the most similar centre; ties take the smallest id. The centres are broadcast, up to ``most_centres``; more are an error."""
    if centres.limit(most_centres + 1).count() > most_centres:
        raise ValueError("more centres than may be broadcast; pool them first")
    s = points.crossJoin(F.broadcast(centres)).withColumn("sim", blended(F.col("label") == F.col("clabel"), F.col("v"), F.col("cv")))
    best = s.groupBy("vec_id").agg(F.min(F.struct((-F.col("sim")).alias("m"), F.col("centre"))).alias("x"))
    return best.select("vec_id", F.col("x.centre").alias("centre"), (-F.col("x.m")).alias("sim"))
