"""Replaying recorded merges: where to cut, and the labels at a cut, as relations over all meetings at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.params import DEFAULTS
from lodestrata.runtime import settled


def gap_cuts(merges: DataFrame, p=DEFAULTS) -> DataFrame:
    """meeting_id, threshold, span, dominance, low_separation of merges (meeting_id, step, height).

    The threshold is the middle of the largest gap between neighbouring
    heights (the first of equals), the dominance how many times the second gap
    the largest is; with under three heights the fallback, 0 and 0. ``low``
    separation: the heights are so close, or the gap leads by so little, that
    the cut may not part speakers.
    """
    by = Window.partitionBy("meeting_id")
    d = merges.withColumn("_next", F.lead("height").over(by.orderBy("height", "step")))
    d = d.withColumn("_gap", F.col("_next") - F.col("height"))
    d = d.withColumn("_k", F.row_number().over(by.orderBy(F.col("_gap").desc_nulls_last(), "height")))
    top, second = (F.max(F.when(F.col("_k") == k, F.col("_gap"))) for k in (1, 2))
    mid = F.max(F.when(F.col("_k") == 1, (F.col("height") + F.col("_next")) / 2))
    few = F.count("*") < 3
    out = d.groupBy("meeting_id").agg(
        F.when(few, p.fallback_thr).otherwise(mid).alias("threshold"),
        F.when(few, 0.0).otherwise(F.max("height") - F.min("height")).alias("span"),
        F.when(few, 0.0).otherwise(top / F.greatest(second, F.lit(1e-9))).alias("dominance"),
    )
    return out.withColumn("low_separation", (F.col("span") < p.low_span) | (F.col("dominance") < p.low_dominance))


def labels_at(nodes: DataFrame, merges: DataFrame, cuts: DataFrame) -> DataFrame:
    """meeting_id, node, label: groups after the merges before the first that is lower than the meeting's threshold, numbered by first member.

    nodes: meeting_id, node. merges: meeting_id, step, a, b, height (a takes b
    in; each b once). cuts: meeting_id, threshold. Every node points at what
    took it in; pointers are followed two at a time, so chains of any length
    end after the logarithm of their length in joins, each written to the
    shared folder.
    """
    d = merges.join(cuts.select("meeting_id", "threshold"), "meeting_id")
    stop = d.filter("height < threshold").groupBy("meeting_id").agg(F.min("step").alias("_stop"))
    used = d.join(stop, "meeting_id", "left").filter("_stop IS NULL OR step < _stop").select("meeting_id", F.col("b").alias("node"), "a")
    up = settled(nodes.select("meeting_id", "node").join(used, ["meeting_id", "node"], "left").select("meeting_id", "node", F.coalesce("a", "node").alias("root")))
    while True:
        far = up.select("meeting_id", F.col("node").alias("root"), F.col("root").alias("far"))
        new = settled(up.join(far, ["meeting_id", "root"]).select("meeting_id", "node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")))
        up = new.select("meeting_id", "node", "root")
        if new.filter("moved").isEmpty():
            break
    first = up.groupBy("meeting_id", "root").agg(F.min("node").alias("_first"))
    numbered = first.withColumn("label", F.row_number().over(Window.partitionBy("meeting_id").orderBy("_first")) - 1)
    return up.join(numbered, ["meeting_id", "root"]).select("meeting_id", "node", "label")
