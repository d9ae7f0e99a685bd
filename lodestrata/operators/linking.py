"""Similarity self-joins and groups over a corpus of voices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.runtime import settled, ship


#: Blocks that vectors are dealt to, and vectors in one at most.
_BLOCKS, _LARGEST = 16, 65_536


def _in_block_pairs(vectors: DataFrame, block: int, kernel, schema: str) -> DataFrame:
    """``kernel`` (ids and similarities of two blocks, whether they are one) on each pair of blocks of vectors, in tasks of their own. Nothing is broadcast. Vectors without a label are compared by themselves."""
    blended = "label" in vectors.columns
    vectors = vectors.select("id", "v", (F.col("label") if blended else F.lit(0)).alias("label"))
    n = vectors.count()
    # a vector is sent to each of k blocks: as few as keep cores busy, until a block would outgrow a task
    k = max(min(-(-n // block), _BLOCKS), -(-n // _LARGEST), 1)
    cell = vectors.select("id", "label", "v", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int").alias("cell"))
    # a block meets each block not before it; the pair (i, j) is the group's key
    left = cell.withColumn("other", F.explode(F.sequence(F.col("cell"), F.lit(k - 1)))).select("id", "label", "v", F.col("cell").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"))
    right = cell.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cell")))).select("id", "label", "v", F.col("other").alias("i"), F.col("cell").alias("j"), F.lit(1).alias("side"))

    def product(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g[g.side == 0], g[g.side == 1]
        a, b = np.stack(x.v.to_numpy()), np.stack(y.v.to_numpy())
        p, q, xs, ys = x.id.to_numpy(), y.id.to_numpy(), x.label.to_numpy(), y.label.to_numpy()
        same = int(x.i.iloc[0]) == int(x.j.iloc[0])
        found = []
        for u in range(0, len(a), block):  # a tile of similarities at a time
            for w in range(0, len(b), block):
                r, c = slice(u, u + block), slice(w, w + block)
                s = a[r] @ b[c].T
                if blended:
                    s = 0.35 * s + 0.65 * (xs[r, None] == ys[None, c])
                found.append(kernel(p[r], q[c], s, same))
        return pd.concat(found, ignore_index=True)

    ship(vectors.sparkSession)
    return left.unionByName(right).groupBy("i", "j").applyInPandas(product, schema)


def similar_pairs(vectors: DataFrame, least: float, block: int = 2048) -> DataFrame:
    """a, b (a < b), sim: pairs of ``id``, ``label``, ``v`` whose blended similarity reaches ``least``.

    Vectors are packed into blocks; each pair of blocks is one matrix product
    in a task of its own, and no pair of rows is listed but those found.
    """

    def found(x: np.ndarray, y: np.ndarray, s: np.ndarray, same: bool) -> pd.DataFrame:
        p, q = np.nonzero(s >= least)
        u, w = x[p], y[q]
        keep = u < w if same else u != w
        return pd.DataFrame({"a": np.minimum(u, w)[keep], "b": np.maximum(u, w)[keep], "sim": s[p, q][keep]})

    return _in_block_pairs(vectors, block, found, "a long, b long, sim double")


def _forest(x: np.ndarray, y: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its group) for all nodes of two sets that ``near`` ties together, smallest ones but left out. Each row and column is looked at once."""
    lx, ly = x.copy(), y.copy()
    on = near.any(axis=1)
    x, lx, near = x[on], lx[on], near[on]
    also = near.any(axis=0)
    y, ly, near = y[also], ly[also], near[:, also]
    if not len(x):
        return x, x
    # from each unseen node its group is reached, a set of rows and columns at a time
    todo = np.ones(len(x), bool)
    for i in range(len(x)):
        if not todo[i]:
            continue
        rows, inside, cols = np.array([i]), np.zeros(len(x), bool), np.zeros(len(y), bool)
        while len(rows):
            inside[rows] = True
            fresh = near[rows].any(axis=0) & ~cols
            cols |= fresh
            rows = np.flatnonzero(near[:, fresh].any(axis=1) & ~inside)
        low = min(x[inside].min(), y[cols].min())
        lx[inside], ly[cols], todo[inside] = low, low, False
    node, label = np.concatenate([x, y]), np.concatenate([lx, ly])
    keep = node != label
    return node[keep], label[keep]


def similar_groups(vectors: DataFrame, least: float, block: int = 2048) -> DataFrame:
    """node, label: components of the similar pairs, as ``connected(similar_pairs(...))``; nodes without a partner have no row.

    A pair of blocks gives a row for each vector at most, not one for each
    pair: of a dense group only what ties it together is listed.
    """

    def ties(x: np.ndarray, y: np.ndarray, s: np.ndarray, same: bool) -> pd.DataFrame:
        near = (s >= least) & (x[:, None] != y[None, :])
        node, label = _forest(x, y, near)
        return pd.DataFrame({"a": label, "b": node}).drop_duplicates()

    return connected(_in_block_pairs(vectors, block, ties, "a long, b long"))


def connected(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each component of the pairs (a, b); minimum labels spread until nothing changes, doubling their reach each round."""
    e = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settled(e.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        heard = e.join(labels, e["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        low = labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("was"))
        jump = low.alias("x").join(low.select(F.col("node").alias("n2"), F.col("label").alias("l2")).alias("y"), F.col("x.label") == F.col("y.n2")).select("x.node", F.least("x.label", "l2").alias("label"), "x.was")
        new = settled(jump)
        if new.filter("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def cannot_link(atoms: DataFrame, durable: float, guard: int) -> DataFrame:
    """meeting_id, a, b: atoms of different labels in one window, both at least ``durable`` seconds, in windows of at most ``guard`` labels."""
    d = atoms.select("meeting_id", "win", "local_label", "sec", "vec_id")
    few = d.groupBy("meeting_id", "win").agg(F.count_distinct("local_label").alias("k")).filter(F.col("k") <= guard).drop("k")
    d = d.filter(F.col("sec") >= durable).join(few, ["meeting_id", "win"], "left_semi")
    o = d.select("meeting_id", "win", F.col("local_label").alias("ol"), F.col("vec_id").alias("b"))
    return d.withColumnRenamed("vec_id", "a").join(o, ["meeting_id", "win"]).filter((F.col("a") < F.col("b")) & (F.col("local_label") != F.col("ol"))).select("meeting_id", "win", "a", "b")


def lifted(apart: DataFrame, labelled: DataFrame) -> DataFrame:
    """meeting_id, ca, cb (ca < cb): clusters that hold atoms of a parted pair (meeting_id, a, b), so may not become one. labelled: meeting_id, vec_id, cluster (-1: nobody's)."""
    c = labelled.filter("cluster >= 0")
    d = apart.join(c.select("meeting_id", F.col("vec_id").alias("a"), F.col("cluster").alias("x")), ["meeting_id", "a"]).join(c.select("meeting_id", F.col("vec_id").alias("b"), F.col("cluster").alias("y")), ["meeting_id", "b"])
    return d.filter("x <> y").select("meeting_id", F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb")).distinct()


def min_k(atoms: DataFrame, durable: float, guard: int) -> DataFrame:
    """meeting_id, min_k: the most durable labels in one window; windows of more than ``guard`` don't count; 1 at least."""
    k = atoms.filter(F.col("sec") >= durable).groupBy("meeting_id", "win").agg(F.count_distinct("local_label").alias("k")).filter(F.col("k") <= guard)
    every = atoms.select("meeting_id").distinct()
    return every.join(k.groupBy("meeting_id").agg(F.max("k").alias("k")), "meeting_id", "left").select("meeting_id", F.coalesce("k", F.lit(1)).alias("min_k"))


def core_set(rows: DataFrame, least: float, *key: str) -> DataFrame:
    """Rows of at least ``least`` seconds; if there are none in the group, all with any; if none, the longest (ties: the first vec_id)."""
    w = Window.partitionBy(*key)
    d = rows.withColumn("_a", F.max((F.col("sec") >= least).cast("int")).over(w)).withColumn("_b", F.max((F.col("sec") > 0).cast("int")).over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc("sec"), "vec_id")))
    return d.filter(F.when(F.col("_a") == 1, F.col("sec") >= least).when(F.col("_b") == 1, F.col("sec") > 0).otherwise(F.col("_k") == 1)).drop("_a", "_b", "_k")
