"""Centroid clustering with exact integer results from float32 products.

Vectors are scaled to integers. A float32 product gives every vector's score
for every centroid with a bound on its rounding error; centroids whose
interval reaches below the least upper end are the shortlist. Where it holds
one, that is the nearest; the others' distances are computed once more in
integers, and the smallest number wins a tie.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import _common as C

#: Rounding unit of float32.
_U = 2.0**-24


def usable(v: Column, dim: int) -> Column:
    """Exactly ``dim`` components, none null, NaN or infinite."""
    return F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as integers; an error where squared distances wouldn't fit 63 bits."""
    out = np.floor(x.astype(np.float64) * scale)
    if out.size and 4.0 * out.shape[1] * float(np.abs(out).max()) ** 2 >= 2.0**63:
        raise ValueError("components are too large for distances of 63 bits")
    return out.astype(np.int64)


def matrix(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are usable, and their integers."""
    ok = pc.equal(pc.list_value_length(column), dim).fill_null(False)
    x = column.filter(ok).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)  # nulls become NaN
    finite = np.isfinite(x).all(axis=1)
    keep = ok.to_numpy(zero_copy_only=False).copy()
    keep[keep] = finite
    return keep, scaled(x[finite], scale)


class Screen:
    """Nearest of fixed integer centroids, exactly."""

    def __init__(self, centroids: np.ndarray):
        self.exact = centroids
        self.single = centroids.astype(np.float32).T.copy()
        self.square = (centroids * centroids).sum(axis=1)
        self.square32 = self.square.astype(np.float32)
        self.length = np.sqrt(self.square.astype(np.float64))
        d = centroids.shape[1] + 3  # two conversions and a product a term, and the sums
        self.gamma = d * _U / (1 - d * _U)

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of |c|^2 - 2 x.c for each row and centroid.

        However the sums of a product are ordered, it errs by at most gamma
        |x| |c|; the rest is the rounding of |c|^2 and of the difference. The
        bound itself is computed in float64 and widened by a thousandth.
        """
        product = (x.astype(np.float32) @ self.single).astype(np.float32)
        score = (self.square32[None, :] - np.float32(2) * product).astype(np.float64)
        reach = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * self.length[None, :]
        error = 1.001 * ((2 * self.gamma + 5 * _U) * reach + 5 * _U * self.square[None, :].astype(np.float64))
        return score - error, score + error

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the squared distance to it, rows in blocks of about four million scores."""
        cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        step = max(1, 4_000_000 // len(self.exact))
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            low, high = self.intervals(part)
            near = low <= high.min(axis=1, keepdims=True)
            at = near.argmax(axis=1)  # the first of the shortlist
            open_ = np.flatnonzero(near.sum(axis=1) > 1)
            if len(open_):
                at[open_] = self._settle(part[open_], near[open_])
            cluster[lo : lo + step] = at
            gap = part - self.exact[at]
            distance[lo : lo + step] = np.einsum("ij,ij->i", gap, gap)
        return cluster, distance

    def _settle(self, x: np.ndarray, near: np.ndarray, most: int = 65_536) -> np.ndarray:
        """Of each row's shortlist the nearest in integers, of equals the smallest number."""
        row, number = np.nonzero(near)  # by row, then number
        d = np.empty(len(row), np.int64)
        for lo in range(0, len(row), most):
            gap = x[row[lo : lo + most]] - self.exact[number[lo : lo + most]]
            d[lo : lo + most] = np.einsum("ij,ij->i", gap, gap)
        order = np.lexsort((number, d, row))
        first = np.searchsorted(row[order], np.arange(len(x)))
        return number[order][first]


def starts(vectors: DataFrame, k: int, scale: int, dim: int, seed: int) -> np.ndarray:
    """The ``k`` usable vectors whose sha256 of ``seed:vec_id`` is smallest, in its order; rows without vec_id don't count, rows that repeat one go by their vectors."""
    named = vectors.filter(usable(F.col("embedding"), dim) & F.col("vec_id").isNotNull())
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("long").cast("string")), 256)
    rows = named.select(h.alias("h"), "embedding").orderBy("h", "embedding").limit(k).collect()  # k rows
    return scaled(np.array([r.embedding for r in rows], np.float64).reshape(-1, dim), scale)


def means(vectors: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: componentwise floor(sum / count); empty ones stay. Tasks send a row a cluster and component, Spark adds them."""
    k, dim = centroids.shape

    def make():
        screen, count, total = Screen(centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)

        def work(batch):
            if batch is not None:
                _, x = matrix(batch.column("embedding"), dim, scale)
                at, _ = screen.assign(x)
                np.add.at(total, at, x)
                np.add(count, np.bincount(at, minlength=k), out=count)
                return
            held = np.flatnonzero(count)
            part = np.tile(np.arange(-1, dim), len(held))
            yield {"cluster": pa.array(np.repeat(held, dim + 1), pa.int32()), "part": pa.array(part, pa.int32()), "total": pa.array(np.concatenate([count[held, None], total[held]], axis=1).ravel(), pa.int64())}

        return work

    sums = C.map_rows(vectors.select("embedding"), "cluster int, part int, total long", make, last=True).groupBy("cluster", "part").agg(F.sum("total").alias("total"))
    new, count, total = centroids.copy(), [0] * k, [[0] * dim for _ in range(k)]
    for r in sums.collect():  # k * (dim + 1) numbers
        if r.part < 0:
            count[r.cluster] = r.total
        else:
            total[r.cluster][r.part] = r.total
    for c in range(k):
        if count[c]:
            new[c] = [s // count[c] for s in total[c]]
    return new


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of ``vectors`` (vec_id, embedding).

    Vectors that aren't usable give no row: null, of other length, or with a
    component that is null, NaN or infinite. Rows that repeat a vec_id count
    each; one without vec_id is clustered, but starts no centroid. Fewer than
    ``k`` usable vectors make fewer centroids, none give no rows. Equal
    distances go to the smaller number, so of equal centroids the later ones
    are empty and stay. Other columns aren't read. Components beyond
    2^63 / distances are an error.

    A round reads the table once and sends k * dim numbers a task; the
    centroids, k * dim integers, go with the tasks.
    """
    if k * dim > 4_000_000:
        raise ValueError("the centroids are too many to send with every task")
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    c = starts(vectors, k, scale, dim, seed)
    for _ in range(rounds if len(c) else 0):
        c = means(vectors, c, scale)

    def make():
        screen = Screen(c) if len(c) else None

        def work(batch):
            keep, x = matrix(batch.column("embedding"), dim, scale)
            if screen is not None:
                at, d = screen.assign(x)
                yield {"vec_id": batch.column("vec_id").filter(pa.array(keep)), "cluster": pa.array(at, pa.int32()), "distance": pa.array(d, pa.int64())}

        return work

    found = C.Workspace(vectors.sparkSession, "centroids").table(C.map_rows(vectors, "vec_id long, cluster int, distance long", make), "assigned")
    inertia = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k numbers
    told = [(n, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, c[n].tolist())).encode()).hexdigest()) for n, s in sorted(inertia.items())]
    about = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
