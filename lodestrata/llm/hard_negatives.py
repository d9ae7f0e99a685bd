"""Hard negatives by branch and bound over ball trees.

Rows are dealt into blocks; every block becomes a ball tree in its task. For
an anchor q and a node with centre c and radius r all inner products lie
between q.c - |q| r and q.c + |q| r. A node is left out if these bounds miss
the score window, or lie strictly beneath the anchor's k-th best so far (or at
it, where all its rows have larger ids). Anchors meet the blocks in blocks of
their own, so that one task holds one of each; the best of all blocks are
ranked once more. Scores are integers and exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.runtime import ship

_NONE = -(2**62)
_LAST = 2**63 - 1


class BallTree:
    """Rows of integer vectors, halved along the line between two far rows; labels are parted first, so that most nodes hold one label."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = 128):
        order = np.lexsort((ids,))
        self.x, self.ids, self.labels, self.leaf = x[order], ids[order], labels[order], leaf
        self.nodes: list[tuple] = []
        self.products = 0
        if len(x):
            self._grow(np.arange(len(x)))

    def _grow(self, rows: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        v = self.x[rows].astype(np.float64)
        centre = v.mean(axis=0)
        away = np.sqrt(((v - centre) ** 2).sum(axis=1))
        labels = self.labels[rows]
        children = ()
        if len(rows) > self.leaf:
            if labels.min() < labels.max():
                by = np.argsort(labels, kind="stable")
                edges = np.flatnonzero(np.diff(labels[by])) + 1
                half = int(edges[np.abs(edges - len(rows) // 2).argmin()])
            else:
                a = v[away.argmax()]
                b = v[((v - a) ** 2).sum(axis=1).argmax()]
                by = np.argsort(v @ (b - a), kind="stable")
                half = len(rows) // 2
            children = tuple(self._grow(np.sort(part)) for part in (rows[by[:half]], rows[by[half:]]))
        length = float(np.sqrt((centre**2).sum()))
        self.nodes[at] = (centre, float(away.max()) * (1 + 1e-9) + 1e-9 * (length + 1), length, int(labels.min()), int(labels.max()), int(self.ids[rows[0]]), children, rows if not children else None)
        return at

    def best(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (n x k, best first; missing: no score) of the rows with low <= score <= high whose label is (``same``) or isn't the query's; rows with the query's own id are left out where ``same``."""
        most = float(np.abs(q).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * max(1, q.shape[1])
        if most >= 2.0**61:
            raise ValueError("components are too large for scores of 63 bits")
        kind = np.float64 if most < 2.0**53 else np.int64  # either way products are exact
        x, q, qf = self.x.astype(kind), q.astype(kind), q.astype(np.float64)
        reach = np.sqrt((qf**2).sum(axis=1)) * (1 + 1e-12)
        score, found = np.full((len(q), k), _NONE, kind), np.full((len(q), k), _LAST, np.int64)
        todo = [(0, np.arange(len(q)))] if self.nodes and len(q) else []
        while todo:
            node, on = todo.pop()
            centre, radius, length, first, last, least, children, rows = self.nodes[node]
            mid = qf[on] @ centre
            slack = 1e-9 * (reach[on] * (radius + length) + 1)
            cap = high[on] if kind is np.float64 else high[on] + slack  # beyond 2^53 a float may fall short of it
            upper = np.minimum(np.floor(mid + reach[on] * radius + slack), cap)
            lower = np.ceil(mid - reach[on] * radius - slack)
            kth, kid = score[on, -1], found[on, -1]
            fits = (upper >= low[on]) & (lower <= high[on]) & ((upper > kth) | ((upper == kth) & (least < kid)))
            fits &= ((label[on] >= first) & (label[on] <= last)) if same else ((label[on] != first) | (label[on] != last))
            on = on[fits]
            if not len(on):
                continue
            if children:
                # the child that promises more goes first: it is pushed last
                promise = [(float((qf[on] @ self.nodes[c][0]).sum()), c) for c in children]
                todo.extend((c, on) for _, c in sorted(promise))
                continue
            self.products += len(on) * len(rows)
            s = q[on] @ x[rows].T
            ids = self.ids[rows]
            kth, kid = score[on, -1:], found[on, -1:]
            ok = (s >= low[on, None]) & (s <= high[on, None]) & ((s > kth) | ((s == kth) & (ids[None, :] < kid)))
            alike = label[on, None] == self.labels[rows][None, :]
            ok &= (alike & (ids[None, :] != own[on, None])) if same else ~alike
            better = ok.any(axis=1)
            if not better.any():
                continue
            s, ok, on = s[better], ok[better], on[better]
            s = np.where(ok, s, _NONE)
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]  # rows are in order of ids
            new = np.take_along_axis(s, top, 1)
            both, names = np.concatenate([score[on], new], axis=1), np.concatenate([found[on], np.where(new > _NONE, ids[top], _LAST)], axis=1)
            order = np.lexsort((names, -both), axis=-1)[:, :k]
            score[on], found[on] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        return score.astype(np.int64), found


def _matrix(lists: pd.Series, dim: int) -> np.ndarray:
    """Integer vectors as rows; what a shorter one lacks is zero."""
    out = np.zeros((len(lists), dim), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _search(queries: pd.DataFrame, rows: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """place (of the query), id and score of the ``k`` best rows. queries: anchor_id, label, v, low, high."""
    dim = max([len(v) for d in (queries, rows) for v in d.v], default=0)
    tree = BallTree(_matrix(rows.v, dim), rows.vec_id.to_numpy(), rows.label.to_numpy())
    score, found = tree.best(_matrix(queries.v, dim), queries.anchor_id.to_numpy(), queries.label.to_numpy(), queries.low.to_numpy(np.int64), queries.high.to_numpy(np.int64), k, same)
    place, rank = np.nonzero(score > _NONE)
    return pd.DataFrame({"place": place, "id": found[place, rank], "score": score[place, rank]})


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v (floor(scale * x)) of the rows whose id, label, vector and components are there and finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    return d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def _dealt(rows: DataFrame, key: str, blocks: int, others: int, first: str, second: str) -> DataFrame:
    """Rows of ``blocks`` blocks by a hash of ``key``, each repeated for all ``others`` blocks of the other side."""
    d = rows.withColumn(first, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    return d.withColumn(second, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block: int = 8192, anchor_block: int = 2048) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (vec_id, label, v: integers).

    Anchors are the rows where ``anchor`` holds; of rows that repeat an
    anchor's id the one with the smallest (label, v) is the anchor. Its
    positives are the ``positives`` other rows (other ids) of its label with
    the highest inner products, and for each the ``negatives`` best rows of
    other labels with low * positive <= 100 * negative <= high * positive;
    smaller ids win ties, repeated rows count each. A positive without such
    rows gives none, nor does an anchor without positives or a table without
    rows. Shorter vectors end in zeros. Scores beyond 61 bits are an error.

    Every anchor meets every row, in pairs of blocks: a task holds ``block``
    rows and ``anchor_block`` anchors whatever labels or copies are frequent,
    and gives ``negatives`` rows an anchor and positive at most. An anchor is
    sent once a block of rows, a row once a block of anchors.
    """
    ship(rows.sparkSession)
    rows = rows.select("vec_id", "label", "v")
    anchors = rows.filter(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select(F.col("vec_id").alias("anchor_id"), F.col("a.label").alias("label"), F.col("a.v").alias("v"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(anchor).alias("a")).first()
    n, m = max(1, -(-sizes.n // block)), max(1, -(-sizes.a // anchor_block))
    dealt = _dealt(rows, "vec_id", n, m, "j", "i").groupBy("i", "j")

    def near(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        got = _search(q.assign(low=_NONE + 1, high=2**62), r, positives, True)
        return pd.DataFrame({"anchor_id": q.anchor_id.to_numpy()[got.place], "positive_id": got.id, "positive_score": got.score})

    asked = _dealt(anchors, "anchor_id", m, n, "i", "j").groupBy("i", "j")
    found = asked.cogroup(dealt).applyInPandas(near, "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= positives)
    listed = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("k", "positive_id", "positive_score"))).alias("p"))  # ``positives`` entries at most

    def windowed(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        at = np.repeat(np.arange(len(q)), [len(p) for p in q.p])
        each = [e for p in q.p for e in p]
        w = q.iloc[at].assign(k=[e["k"] for e in each], positive_id=[e["positive_id"] for e in each], positive_score=[e["positive_score"] for e in each])
        w = w.assign(low=[-(-low * int(s) // 100) for s in w.positive_score], high=[high * int(s) // 100 for s in w.positive_score])
        w = w[w.low <= w.high]
        got = _search(w, r, negatives, False)
        w = w.iloc[got.place.to_numpy()]
        return pd.DataFrame({"anchor_id": w.anchor_id.to_numpy(), "k": w.k.to_numpy(), "positive_id": w.positive_id.to_numpy(), "negative_id": got.id, "positive_score": w.positive_score.to_numpy(), "negative_score": got.score})

    asked = _dealt(anchors.join(listed, "anchor_id"), "anchor_id", m, n, "i", "j").groupBy("i", "j")
    mined = asked.cogroup(dealt).applyInPandas(windowed, "anchor_id long, k int, positive_id long, negative_id long, positive_score long, negative_score long")
    best = Window.partitionBy("anchor_id", "k").orderBy(F.desc("negative_score"), "negative_id")
    out = mined.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 256)
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)
