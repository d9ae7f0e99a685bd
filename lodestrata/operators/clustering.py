"""Constrained clustering of one meeting's atoms, as numpy kernels per group.

A meeting is bounded by its length (a few hundred atoms an hour), so a group
fits one task; groups never depend on each other.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.vectors import norm
from lodestrata.operators.matching import pool
from lodestrata.params import DEFAULTS
from lodestrata.runtime import ship


#: Averages this near are equal, so that the order of a sum decides nothing.
_TIE = 1e-12
#: Rows whose similarities with all others are held at once.
_ROWS = 256
#: Rows up to which all eigenvalues are computed.
_DENSE = 2000


def factors(label: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows whose dot products are the similarity blended from label and vector, so that no matrix of all pairs is held."""
    hot = label[:, None] == np.unique(label)[None, :]
    return np.concatenate([np.sqrt(0.65) * hot, np.sqrt(0.35) * v], axis=1)


def sides(s: np.ndarray | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(p, q) with similarities p @ q.T: such a pair is taken as it is, a matrix with the unit matrix."""
    return s if isinstance(s, tuple) else (np.asarray(s, float), np.eye(len(s)))


def part_of(s: np.ndarray | tuple, rows: np.ndarray) -> np.ndarray | tuple:
    return tuple(x[rows] for x in s) if isinstance(s, tuple) else s[np.ix_(rows, rows)]


def sums(x: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, x.shape[1]))
    np.add.at(out, own, x)
    return out


def cannot(win: np.ndarray, local: np.ndarray, sec: np.ndarray, durable: float, guard: int) -> list[list[int]]:
    """Each row's parted rows: those of its window, of another label, both durable, where the window has at most ``guard`` labels."""
    labels: dict = {}
    rows: dict = {}
    for i, (w, name) in enumerate(zip(win.tolist(), local.tolist(), strict=True)):
        labels.setdefault(w, set()).add(name)
        if sec[i] >= durable:
            rows.setdefault(w, []).append(i)
    out: list[list[int]] = [[] for _ in range(len(win))]
    for w, here in rows.items():
        if len(labels[w]) <= guard:
            for i in here:
                out[i] = [j for j in here if local[j] != local[i]]
    return out


def parted(block: np.ndarray | list) -> list[list[int]]:
    """Parted rows by row, from a matrix or as they are."""
    return [np.flatnonzero(r).tolist() for r in block] if isinstance(block, np.ndarray) else block


def linkage(s: np.ndarray | tuple, block: np.ndarray | list) -> list[tuple[int, int, float]]:
    """Average linkage to completion, never joining what ``block`` parts (and what its members are parted from).

    Merges (i, j, height) with i < j; i takes j in. Of equal averages the
    first pair in row order wins. Clusters are sums of rows, so memory grows
    with the rows. Each row keeps its best later partner; where a merge took
    that one, its average stays as a bound (a merged cluster is no nearer than
    the nearer of the two) and is looked for again when it comes first.
    """
    p, q = (x.astype(float) for x in sides(s))
    n = len(p)
    apart = [set(x) for x in parted(block)]
    size, alive, sure = np.ones(n), np.ones(n, bool), np.ones(n, bool)
    best, to = np.full(n, -np.inf), np.full(n, -1)
    live, place = np.arange(n), np.arange(n)  # cluster at a place, place of a cluster
    merges: list[tuple[int, int, float]] = []

    def closed(mean: np.ndarray, at: int) -> np.ndarray:
        mean[~alive[-len(mean) :]] = -np.inf
        far = place[list(apart[live[at]])] - (len(alive) - len(mean)) if apart[live[at]] else np.zeros(0, int)
        mean[far[far >= 0]] = -np.inf
        return mean

    def first(mean: np.ndarray, offset: int) -> tuple[float, int]:
        top = mean.max(initial=-np.inf)
        return (float(top), offset + int((mean >= top - _TIE).argmax())) if top > -np.inf else (-np.inf, -1)

    for lo in range(0, n, _ROWS):
        near = p[lo : lo + _ROWS] @ q[lo:].T
        for r, mean in enumerate(near):
            best[lo + r], to[lo + r] = first(closed(mean[r + 1 :], lo + r), lo + r + 1) if lo + r + 1 < n else (-np.inf, -1)
    while n:
        top = best.max()
        if top == -np.inf:
            break
        a = int((best >= top - _TIE).argmax())
        if not sure[a]:
            rest = slice(a + 1, None)
            best[a], to[a] = first(closed(p[rest] @ q[a] / (size[a] * size[rest]), a), a + 1) if a + 1 < len(p) else (-np.inf, -1)
            sure[a] = True
            continue
        b = int(to[a])
        i, j = int(live[a]), int(live[b])
        merges.append((i, j, float(best[a])))
        p[a] += p[b]
        q[a] += q[b]
        size[a] += size[b]
        alive[b] = False
        best[b], to[b] = -np.inf, -1
        for c in apart[j]:
            apart[c].discard(j)
            apart[c].add(i)
        apart[i] |= apart[j]
        apart[j] = set()
        mean = closed(p @ q[a] / (size * size[a]), a)
        lost = (to == a) | (to == b)
        cand, was = mean[:a], best[:a]
        better = cand > was + _TIE
        same = ~better & (cand >= was - _TIE) & (was > -np.inf)
        take = better | (same & (lost[:a] | (sure[:a] & (to[:a] > a))))
        to[lost] = -1
        sure[lost] = False
        was[better] = cand[better]
        to[:a][take] = a
        sure[:a][take] = True
        best[a], to[a] = first(mean[a + 1 :], a + 1)
        sure[a] = True
        if len(alive) > 64 and 2 * alive.sum() < len(alive):
            moved = np.cumsum(alive) - 1
            to = np.where(to >= 0, moved[to], -1)[alive]
            p, q, size, sure, best, live = (x[alive] for x in (p, q, size, sure, best, live))
            alive = np.ones(len(live), bool)
            place[live] = np.arange(len(live))
    return merges


def labels_at(n: int, merges: list[tuple[int, int, float]], least: float) -> np.ndarray:
    """Labels after the merges of at least that height, numbered by first member. Replaying stops at the first lower one."""
    parent = list(range(n))
    for i, j, h in merges:
        if h < least:
            break
        parent[j] = i

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    seen: dict[int, int] = {}
    return np.array([seen.setdefault(root(x), len(seen)) for x in range(n)], int)


def gap_threshold(heights: list[float]) -> tuple[float, float, float]:
    """Middle of the largest gap of the sorted heights (the first of equals), the span of the heights, and how many times the second gap the largest is."""
    if len(heights) < 3:
        return DEFAULTS.fallback_thr, 0.0, 0.0
    h = np.sort(heights)
    gaps = np.diff(h)
    at = int(gaps.argmax())
    second = max(float(np.delete(gaps, at).max()), 1e-9)
    return float((h[at] + h[at + 1]) / 2), float(h[-1] - h[0]), float(gaps[at] / second)


def low_separation(span: float, dominance: float, p=DEFAULTS) -> bool:
    """Heights so close, or a gap so little above the next, that the cut may not part speakers."""
    return span < p.low_span or dominance < p.low_dominance


def cosines(inner: np.ndarray, a: float, b: np.ndarray) -> np.ndarray:
    """Cosines of the unit centroids of sets of unit vectors, from the sums of dot products between them and within each."""
    ok = (b > 1e-18) & (a > 1e-18)
    return np.where(ok, inner / np.sqrt(np.where(ok, a * b, 1.0)), -np.inf)


def absorb(labels: np.ndarray, s: np.ndarray | tuple, sec: np.ndarray, block: np.ndarray | list, least: float) -> np.ndarray:
    """Clusters under ``least`` seconds join the legal cluster whose unit centroid is nearest (ties: the first), the smallest that can first, until none can."""
    p, q = sides(s)
    ids, own = np.unique(labels, return_inverse=True)
    k = len(ids)
    p, q, weight = sums(p, own, k), sums(q, own, k), np.bincount(own, sec, k)
    length, alive = (p * q).sum(axis=1), np.ones(k, bool)
    far: list[set[int]] = [set() for _ in range(k)]
    for i, others in enumerate(parted(block)):
        far[own[i]].update(own[others].tolist())
    into = list(range(k))
    queue = [(float(weight[c]), c) for c in range(k) if weight[c] < least]
    heapify(queue)
    while queue:
        w, c = heappop(queue)
        if not alive[c] or w != weight[c]:
            continue
        legal = alive.copy()
        legal[[c, *far[c]]] = False
        near = np.flatnonzero(legal)
        if not len(near):  # nor later: what is legal only shrinks
            continue
        score = cosines(p[near] @ q[c], length[c], length[near])
        o = int(near[(score >= score.max() - _TIE).argmax()])
        p[o] += p[c]
        q[o] += q[c]
        length[o], weight[o] = p[o] @ q[o], weight[o] + weight[c]
        alive[c] = False
        for x in far[c]:
            far[x].discard(c)
            far[x].add(o)
        far[o] |= far[c]
        into[c] = o
        if weight[o] < least:
            heappush(queue, (float(weight[o]), o))
    for c in range(k):
        while into[into[c]] != into[c]:
            into[c] = into[into[c]]
    return ids[np.array(into, int)[own]] if k else labels.copy()


def refine(labels: np.ndarray, s: np.ndarray | tuple, block: np.ndarray | list, sweeps: int = 3) -> np.ndarray:
    """Each atom moves to the cluster whose unit centroid, the atom itself left out, it is nearest to.

    Members of single clusters stay. What is legal is told at the start of a
    sweep; a move that has become illegal meanwhile isn't made, nor another.
    """
    p, q = sides(s)
    apart = parted(block)
    ids, own = np.unique(labels, return_inverse=True)
    k = len(ids)
    alone = (p * q).sum(axis=1)
    for _ in range(sweeps):
        start, moved = own.copy(), False
        ps, qs, size = sums(p, own, k), sums(q, own, k), np.bincount(own, minlength=k)
        length = (ps * qs).sum(axis=1)
        for i in range(len(own)):
            c = own[i]
            if size[c] == 1:
                continue
            inner = ps @ q[i]
            within = length.copy()
            within[c] += alone[i] - 2 * inner[c]
            rest = inner.copy()
            rest[c] -= alone[i]
            score = cosines(rest, 1.0, np.where(size > 0, within, 0.0))
            illegal = start[apart[i]]
            score[illegal[illegal != c]] = -np.inf
            top = score.max()
            at = int((score >= top - _TIE).argmax()) if top > -np.inf else c
            if at != c and not (own[apart[i]] == at).any():
                length[c], length[at] = within[c], length[at] + alone[i] + 2 * inner[at]
                ps[c] -= p[i]
                ps[at] += p[i]
                size[c] -= 1
                size[at] += 1
                own[i] = at
                moved = True
        if not moved:
            break
    return ids[own]


def repair(labels: np.ndarray, sec: np.ndarray, block: np.ndarray | list) -> np.ndarray:
    """No two parted atoms share a cluster: of such a pair, the first in row order each time, the shorter (of equals the earlier) gets a cluster of its own."""
    labels = labels.copy()
    fresh = labels.max(initial=-1) + 1
    for i, others in enumerate(parted(block)):
        for j in sorted(others):
            if i < j and labels[i] == labels[j]:
                labels[i if sec[i] <= sec[j] else j] = fresh
                fresh += 1
    return labels


def core_rows(sec: np.ndarray, least: float) -> np.ndarray:
    """Rows of at least ``least`` seconds; else all with any; else the longest."""
    for rows in (np.flatnonzero(sec >= least), np.flatnonzero(sec > 0)):
        if len(rows):
            return rows
    return np.array([int(sec.argmax())]) if len(sec) else np.zeros(0, int)


def attach_weak(labels: np.ndarray, weak: np.ndarray, s: np.ndarray | tuple, win: np.ndarray, local: np.ndarray, least: float) -> np.ndarray:
    """Weak atoms (label -1 so far) join the nearest centroid of the others' clusters that holds no other label of their window, if that one reaches ``least``; else they stay -1."""
    out = labels.copy()
    sure = np.flatnonzero(labels >= 0)
    if not len(sure):
        return out
    p, q = sides(s)
    ids, own = np.unique(labels[sure], return_inverse=True)
    ps, qs = sums(p[sure], own, len(ids)), sums(q[sure], own, len(ids))
    length = (ps * qs).sum(axis=1)
    held: dict = {}
    for r, c in zip(sure.tolist(), own.tolist(), strict=True):
        held.setdefault(win[r], []).append((c, local[r]))
    for i in weak:
        if p[i] @ q[i] <= 0:
            continue
        score = cosines(ps @ q[i], float(p[i] @ q[i]), length)
        score[[c for c, name in held.get(win[i], []) if name != local[i]]] = -np.inf
        top = score.max()
        if top >= least:
            out[i] = ids[np.flatnonzero(score >= top - _TIE)[-1]]
    return out


def cluster(s: np.ndarray | tuple, win: np.ndarray, local: np.ndarray, sec: np.ndarray, p=DEFAULTS) -> tuple[np.ndarray, dict]:
    """Labels of one meeting's atoms (-1: nobody's), and k, floor, floor_ok, threshold, low_separation.

    The core set is linked and cut at the largest gap of its heights (at a
    fixed height where no two atoms are parted), small clusters are absorbed,
    atoms refined, parted pairs repaired; then weak atoms are attached.
    """
    core = core_rows(sec, p.min_core)
    sc, wc, lc, dc = part_of(s, core), win[core], local[core], sec[core]
    block = cannot(wc, lc, dc, p.durable_s, p.guard)
    merges = linkage(sc, block)
    thr, low = p.fallback_thr, False
    if any(block):
        thr, span, dominance = gap_threshold([h for *_, h in merges])
        low = low_separation(span, dominance, p)
    got = absorb(labels_at(len(core), merges, thr), sc, dc, block, p.min_cluster_sec)
    got = dense(repair(refine(got, sc, block), dc, block))
    labels = np.full(len(sec), -1)
    labels[core] = got
    labels = attach_weak(labels, np.setdiff1d(np.flatnonzero(sec < p.min_core), core), s, win, local, p.weak_min)
    durable = {}
    for w, name in zip(win[sec >= p.durable_s].tolist(), local[sec >= p.durable_s].tolist(), strict=True):
        durable.setdefault(w, set()).add(name)
    floor = max([len(x) for x in durable.values() if len(x) <= p.guard], default=1)
    k = len(np.unique(got))
    return labels, {"k": k, "floor": floor, "floor_ok": k >= floor, "threshold": thr, "low_separation": low}


def dense(labels: np.ndarray) -> np.ndarray:
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(int(x), len(seen)) for x in labels], int)


def cover(v: np.ndarray, label: np.ndarray, sec: np.ndarray, reach: float = DEFAULTS.cover, most: int = DEFAULTS.max_profiles) -> list[int]:
    """Farthest first: the longest member, then always the one least covered, until all are covered to ``reach`` or ``most`` are chosen."""
    if not len(v):
        return []
    x = factors(label, v)
    chosen = [int(np.argmax(sec))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(most, len(v)):
        near[chosen] = np.inf
        i = int((near <= near.min() + _TIE).argmax())
        if near[i] >= reach:
            break
        chosen.append(i)
        near = np.maximum(near, x @ x[i])
    return chosen


def cluster_meetings(atoms: DataFrame, p=DEFAULTS) -> DataFrame:
    """meeting_id, vec_id, cluster (-1: nobody's), k, floor, floor_ok, low_separation: see ``cluster``."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_id")
        x = factors(g.label.to_numpy(), np.stack(g.v.to_numpy()))
        labels, info = cluster((x, x), g.win.to_numpy(), g.local_label.to_numpy(), g.sec.to_numpy(), p)
        return pd.DataFrame({"meeting_id": g.meeting_id, "vec_id": g.vec_id, "cluster": labels, **{k: info[k] for k in ("k", "floor", "floor_ok", "low_separation")}})

    ship(atoms.sparkSession)
    return atoms.groupBy("meeting_id").applyInPandas(run, "meeting_id long, vec_id long, cluster long, k long, floor long, floor_ok boolean, low_separation boolean")


def merge_steps(atoms: DataFrame, p=DEFAULTS) -> DataFrame:
    """meeting_id, step, a, b, height: every merge of the constrained linkage, to be replayed at any cut."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_id")
        x = factors(g.label.to_numpy(), np.stack(g.v.to_numpy()))
        m = linkage((x, x), cannot(g.win.to_numpy(), g.local_label.to_numpy(), g.sec.to_numpy(), p.durable_s, p.guard))
        ids = g.vec_id.to_numpy()
        return pd.DataFrame({"meeting_id": [int(g.meeting_id.iloc[0])] * len(m), "step": range(len(m)), "a": [ids[i] for i, _, _ in m], "b": [ids[j] for _, j, _ in m], "height": [round(h, 6) for *_, h in m]}, columns=["meeting_id", "step", "a", "b", "height"])

    ship(atoms.sparkSession)
    return atoms.groupBy("meeting_id").applyInPandas(run, "meeting_id long, step long, a long, b long, height double")


def covering_sets(atoms: DataFrame, *key: str, reach: float = DEFAULTS.cover) -> DataFrame:
    """key, vec_id, rank: the members that stand for a person, farthest first."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_id")
        at = cover(np.stack(g.v.to_numpy()), g.label.to_numpy(), g.sec.to_numpy(), reach)
        return pd.DataFrame({**{k: g[k].iloc[at] for k in key}, "vec_id": g.vec_id.iloc[at], "rank": range(1, len(at) + 1)})

    kinds = dict(atoms.dtypes)
    ship(atoms.sparkSession)
    return atoms.groupBy(*key).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", vec_id long, rank long")


def violations(labelled: DataFrame, apart: DataFrame) -> DataFrame:
    """Pairs of ``apart`` (meeting_id, a, b) that share a cluster; must be empty."""
    x = labelled.select("meeting_id", F.col("vec_id").alias("a"), F.col("cluster").alias("ca"))
    y = labelled.select("meeting_id", F.col("vec_id").alias("b"), F.col("cluster").alias("cb"))
    return apart.join(x, ["meeting_id", "a"]).join(y, ["meeting_id", "b"]).filter("ca = cb").select("meeting_id", "a", "b")


def final_centroids(atoms: DataFrame, labelled: DataFrame) -> DataFrame:
    """meeting_id, cluster, v, seconds, n: the unit of each cluster's atoms weighted by seconds; atoms that are nobody's (-1) or have a zero vector don't count."""
    d = atoms.join(labelled.filter("cluster >= 0").select("meeting_id", "vec_id", "cluster"), ["meeting_id", "vec_id"]).filter(norm(F.col("v")) > 0)
    about = d.groupBy("meeting_id", "cluster").agg(F.sum("sec").alias("seconds"), F.count("*").alias("n"))
    return pool(d, "meeting_id", "cluster", weight="sec").join(about, ["meeting_id", "cluster"])


def plain_cluster(v: np.ndarray, sec: np.ndarray, least: float, p=DEFAULTS, sweeps: int = 3) -> np.ndarray:
    """The arm without constraints, for comparison: average linkage of the core at a fixed height, all of it reassigned to the nearest centroid ``sweeps`` times, weak atoms to the nearest centroid however far; zero vectors are nobody's (-1)."""
    core = np.flatnonzero(sec >= p.min_core)
    labels = np.full(len(v), -1)
    if not len(core):
        return labels
    x = v[core]
    got = labels_at(len(core), linkage((x, x), [[]] * len(core)), least)
    k = got.max() + 1

    def centres() -> np.ndarray:
        c = sums(x, got, k) / np.maximum(np.bincount(got, minlength=k), 1)[:, None]
        return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)

    c = centres()
    for _ in range(sweeps):
        got = np.concatenate([(x[lo : lo + _ROWS] @ c.T).argmax(axis=1) for lo in range(0, len(x), _ROWS)])
        c = centres()
    labels[core] = got
    for i in np.flatnonzero(sec < p.min_core):
        labels[i] = int((c @ v[i]).argmax()) if np.linalg.norm(v[i]) > 0 else -1
    return labels


def eigengap(s: np.ndarray | tuple, most: int = 15) -> int:
    """How many clusters the largest gap between the smallest eigenvalues of the affinity's normalised Laplacian tells (the first of equals).

    Beyond ``_DENSE`` rows no matrix is held: a block Krylov space, restarted
    from its best vectors, grows until the residuals leave no doubt which gap
    is the largest.
    """
    p, q = sides(s)
    n = len(p)

    def rows(lo: int) -> np.ndarray:
        a = np.clip(p[lo : lo + _ROWS] @ q.T, 0, None)
        at = np.arange(len(a))
        a[at, lo + at] = 0.0
        return a

    d = np.concatenate([rows(lo).sum(axis=1) for lo in range(0, n, _ROWS)])
    d[d <= 0] = 1e-9
    if n <= _DENSE:
        a = np.concatenate([rows(lo) for lo in range(0, n, _ROWS)])
        w = np.linalg.eigvalsh(np.eye(n) - a / np.sqrt(np.outer(d, d)))[: most + 1]
        return int(np.diff(w).argmax()) + 1 if len(w) > 1 else 1
    scale, k = 1 / np.sqrt(d)[:, None], most + 1

    def image_of(x: np.ndarray) -> np.ndarray:
        return scale * np.concatenate([rows(lo) @ (scale * x) for lo in range(0, n, _ROWS)])

    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(n, 2 * k)))[0]
    image = image_of(basis)
    while True:
        value, y = np.linalg.eigh(basis.T @ image)
        value, y = value[::-1], y[:, ::-1]
        rest = image @ y[:, :k] - basis @ y[:, :k] * value[:k]
        err = np.linalg.norm(rest, axis=0)
        gaps, doubt = -np.diff(value[:k]), err[1:] + err[:-1]
        g = int(gaps.argmax())
        others = np.arange(k - 1) != g
        if (gaps[g] - doubt[g] > (gaps + doubt)[others]).all() or err.max() < 1e-10:
            return g + 1
        if basis.shape[1] >= 12 * k:
            basis, image = basis @ y[:, : 4 * k], image @ y[:, : 4 * k]
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
            rest /= np.maximum(np.linalg.norm(rest, axis=0), 1e-300)
        new = np.linalg.qr(rest)[0]
        new = np.linalg.qr(new - basis @ (basis.T @ new))[0]
        basis, image = np.concatenate([basis, new], axis=1), np.concatenate([image, image_of(new)], axis=1)


def clipped(s: np.ndarray | tuple) -> np.ndarray | tuple:
    """Similarities of -1 to 1. Rows of length 1 have no others, so stay factors."""
    if isinstance(s, tuple):
        if ((s[0] * s[1]).sum(axis=1) <= 1 + 1e-6).all():
            return s
        s = s[0] @ s[1].T
    return np.clip(s, -1.0, 1.0)


def silhouette_of(to: np.ndarray, labels: np.ndarray) -> float:
    """Mean of (b - a) / max(a, b): a to the own cluster's others, b to the nearest other cluster; single members count 0. to: summed distances of each row to each cluster."""
    size = np.bincount(labels)
    row = np.arange(len(labels))
    a = to[row, labels] / np.maximum(size[labels] - 1, 1)
    mean = to / size
    mean[row, labels] = np.inf
    b = mean.min(axis=1)
    return float(np.where(size[labels] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).mean())


def silhouette(distance: np.ndarray, labels: np.ndarray) -> float:
    """``silhouette_of`` a matrix of distances."""
    return silhouette_of(distance @ np.eye(labels.max() + 1)[labels], labels)


def silhouette_k(s: np.ndarray | tuple, most: int = 15) -> int | None:
    """The number of clusters, 2 to ``most``, whose cut of the average linkage has the best silhouette (the smallest of equals); None under three rows. Merges of one height go together."""
    s = clipped(s)
    p, q = sides(s)
    n = len(p)
    merges = linkage(s, [[]] * n)
    heights = [h for *_, h in merges]
    cuts = [labels_at(n, merges, heights[n - k - 1] - _TIE if n - k > 0 else np.inf) for k in range(2, min(most, n - 1) + 1)]
    if not cuts:
        return None
    # cuts are nested, so distances are summed once, by the clusters of the finest
    finest = np.eye(cuts[-1].max() + 1)[cuts[-1]]
    to = np.zeros(finest.shape)
    for lo in range(0, n, _ROWS):
        d = np.clip(1.0 - p[lo : lo + _ROWS] @ q.T, 0, 2)
        at = np.arange(len(d))
        d[at, lo + at] = 0.0
        to[lo : lo + _ROWS] = d @ finest
    best: tuple[float, int] | None = None
    for k, labels in enumerate(cuts, 2):
        if labels.max() == 0:
            continue
        whole = np.zeros((finest.shape[1], labels.max() + 1))
        whole[cuts[-1], labels] = 1.0
        score = silhouette_of(to @ whole, labels)
        if best is None or score > best[0] + _TIE:
            best = (score, k)
    return best[1] if best else None


def estimate_k(atoms: DataFrame, p=DEFAULTS, most: int = 15) -> DataFrame:
    """meeting_id, n, by_gap, by_silhouette: two estimates of how many voices a meeting's core atoms hold."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_id")
        core = core_rows(g.sec.to_numpy(), p.min_core)
        x = factors(g.label.to_numpy()[core], np.stack(g.v.to_numpy())[core])
        return pd.DataFrame({"meeting_id": [g.meeting_id.iloc[0]], "n": [len(core)], "by_gap": [eigengap((x, x), most)], "by_silhouette": pd.array([silhouette_k((x, x), most)], "Int64")})

    ship(atoms.sparkSession)
    return atoms.groupBy("meeting_id").applyInPandas(run, f"meeting_id {dict(atoms.dtypes)['meeting_id']}, n long, by_gap long, by_silhouette long")


def plain_clusters(atoms: DataFrame, least: float = DEFAULTS.fallback_thr, p=DEFAULTS) -> DataFrame:
    """meeting_id, vec_id, cluster by ``plain_cluster``."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_id")
        v = factors(g.label.to_numpy(), np.stack(g.v.to_numpy()))
        return pd.DataFrame({"meeting_id": g.meeting_id, "vec_id": g.vec_id, "cluster": plain_cluster(v, g.sec.to_numpy(), least, p)})

    ship(atoms.sparkSession)
    return atoms.groupBy("meeting_id").applyInPandas(run, f"meeting_id {dict(atoms.dtypes)['meeting_id']}, vec_id long, cluster long")
