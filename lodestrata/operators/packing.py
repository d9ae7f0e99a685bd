"""Batches: length-sorted ones, packed greedily by a fold that runs in range partitions, and windows pooled over the recordings of a queue.

Whether an item opens a batch depends on all before it, but only through where
the last batch began. A part of the sorted items therefore needs to be told
one number, the place of the first batch that opens in it, which is at most
``most`` items from its head. Every part answers beforehand for all these
places where the first batch behind it would open; the driver follows the
answers from part to part, ``most`` + 1 numbers each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.runtime import settled, ship


def _next(lengths: np.ndarray, most: int, spread: float) -> np.ndarray:
    """For each item, if it opens a batch, the place where the next one opens."""
    return np.minimum(np.arange(len(lengths)) + most, np.searchsorted(lengths, spread * lengths, side="right"))


def pack(items: DataFrame, most: int = 32, spread: float = 1.15, part_rows: int = 200_000) -> DataFrame:
    """id, length, batch: items by length (of equals by id) in batches of at most ``most``, none over ``spread`` times its batch's shortest. items: id (unique), length (0 or more, not null).

    The items are sorted over range partitions of about ``part_rows`` and
    written once with their places; each part is folded with the ``most``
    items behind it.
    """
    if most < 1 or spread < 1:
        raise ValueError("a batch holds an item at least, and its shortest")
    ship(items.sparkSession)
    d = items.select("id", F.col("length").cast("double").alias("length"))
    n = d.count()
    parts = max(1, -(-n // part_rows))
    d = settled(d.repartitionByRange(parts, "length", "id").withColumn("part", F.spark_partition_id()))
    sizes = {r["part"]: r["count"] for r in d.groupBy("part").count().collect()}  # as many numbers as parts
    held = sorted(sizes)
    begin = dict(zip(held, np.cumsum([0, *(sizes[p] for p in held)]).tolist(), strict=False))
    ends = {p: begin[p] + sizes[p] for p in held}
    # items near a part's head also go to the parts that end less than ``most`` items before it
    ahead = {}
    for k, q in enumerate(held):
        j = k
        while j and begin[q] - ends[held[j - 1]] < most:
            j -= 1
        ahead[q] = [(p, ends[p]) for p in held[j:k]]
    about = items.sparkSession.createDataFrame([(p, begin[p], ahead[p]) for p in held], "part int, begin long, head array<struct<to:int,end:long>>")
    d = d.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("length", "id")) - 1)
    d = d.join(F.broadcast(about), "part").withColumn("place", F.col("place") + F.col("begin"))  # a row a part
    own = d.select("id", "length", "place", F.col("part").alias("to"), F.lit(False).alias("halo"))
    near = F.filter("head", lambda h: F.col("place") < h["end"] + most)
    halo = d.select("id", "length", "place", F.explode(F.transform(near, lambda h: h["to"])).alias("to"), F.lit(True).alias("halo"))
    rows = settled(own.unionByName(halo))

    def answers(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place")
        size, base = int((~g.halo).sum()), int(g.place.iloc[0])
        nxt = _next(g.length.to_numpy(), most, spread)
        out, opened = np.arange(len(nxt) + 1), np.zeros(len(nxt) + 1, int)
        for i in range(size - 1, -1, -1):
            out[i], opened[i] = out[nxt[i]], opened[nxt[i]] + 1
        first = np.arange(min(size, most + 1))
        return pd.DataFrame({"to": int(g.to.iloc[0]), "at": base + first, "behind": base + out[first], "opened": opened[first]})

    told = rows.groupBy("to").applyInPandas(answers, "to int, at long, behind long, opened long")
    table = {(r["to"], r["at"]): (r["behind"], r["opened"]) for r in told.collect()}  # most + 1 rows a part
    enter, at, count = [], 0, 0
    for p in held:
        if at < ends[p]:
            enter.append((p, at, count))
            behind, opened = table[p, at]
            at, count = behind, count + opened
        else:
            enter.append((p, -1, count))
    known = {p: (a, c) for p, a, c in enter}

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place")
        size, base = int((~g.halo).sum()), int(g.place.iloc[0])
        start, batch = known[int(g.to.iloc[0])]
        nxt = _next(g.length.to_numpy(), most, spread)
        opens = np.zeros(size, int)
        i = start - base
        while start >= 0 and i < size:
            opens[i] = 1
            i = nxt[i]
        g = g.iloc[:size]
        return pd.DataFrame({"id": g.id, "length": g.length, "batch": batch + np.cumsum(opens) - 1})

    return rows.groupBy("to").applyInPandas(walk, f"id {dict(items.dtypes)['id']}, length double, batch long")


def pool_windows(recordings: DataFrame, target: int = 128, most_s: float = 4 * 3600.0) -> DataFrame:
    """queue, batch, recording, first, last, completes: which windows of which recordings are decoded together.

    recordings: queue, recording, place (their order in it), n_windows,
    duration. Windows are pooled in order over recordings; a pool of
    ``target`` windows is a batch, also within a recording. After a recording
    the pool is a batch too if the recordings in flight hold ``most_s``
    seconds, as their audio waits in memory: a recording is in flight until
    the batch of its last window, which ``completes`` it. Recordings without
    windows take no part. A queue's recordings, not their windows, are one
    task's rows.
    """
    if target < 1:
        raise ValueError("a batch holds a window at least")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out, batch, pooled, waiting = [], 0, 0, 0.0
        for r in g[g.n_windows > 0].sort_values(["place", "recording"]).itertuples():
            at = 0
            while at < r.n_windows:
                take = int(min(target - pooled, r.n_windows - at))
                out.append((batch, r.recording, at, at + take - 1, at + take == r.n_windows))
                at, pooled = at + take, pooled + take
                if pooled == target:
                    batch, pooled, waiting = batch + 1, 0, 0.0  # all but this recording are complete
            if pooled:  # its last windows, or those of others, are still to be decoded
                waiting += r.duration
            if waiting >= most_s:
                batch, pooled, waiting = batch + 1, 0, 0.0
        d = pd.DataFrame(out, columns=["batch", "recording", "first", "last", "completes"])
        return d.assign(queue=g["queue"].iloc[0])[["queue", "batch", "recording", "first", "last", "completes"]]

    ship(recordings.sparkSession)
    kinds = dict(recordings.dtypes)
    d = recordings.select("queue", "recording", "place", "n_windows", "duration")
    return d.groupBy("queue").applyInPandas(run, f"queue {kinds['queue']}, batch long, recording {kinds['recording']}, first long, last long, completes boolean")
