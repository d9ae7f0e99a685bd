"""Centroid clustering and hard negatives against plain Python."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from lodestrata.llm import centroids as K
from lodestrata.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, parts=3):
    """Rows of (vec_id, vector, label), with columns whose names the operators use themselves."""
    return spark.createDataFrame(rows, SCHEMA).repartition(parts).selectExpr("*", "'x' AS v", "1 AS i", "'y' AS block", "2 AS cluster", "3 AS score", "4 AS anchor_id")


def usable(v, dim=64):
    return v is not None and (dim is None or len(v) == dim) and all(x is not None and math.isfinite(x) for x in v)


def lloyd(rows, k=16, rounds=3, scale=64, dim=64):
    data = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows if usable(v, dim)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), [float(np.float32(x)) for x in v]) for i, v, *_ in rows if usable(v, dim) and i is not None)[:k]
    cents = [[math.floor(scale * x) for x in v] for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in data:
            own[near(v)[1]].append(v)
        cents = [[sum(col) // len(own[n]) for col in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(cents)]
    got = [(i, *near(v)) for i, v in data] if cents else []
    by, total = defaultdict(int), 0
    for _, d, n in got:
        by[n] += d
        total += d
    return sorted(((i, n, d, by[n], total, hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, d, n in got), key=str)


def blobs(n, dim=64, seed=3, spread=0.3, kinds=8):
    r = random.Random(seed)
    mid = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(kinds)]
    return [(i, [m + r.gauss(0, spread) for m in mid[i * 7 % kinds]], i * 5 % kinds) for i in range(n)]


ODD = [(900, None, 1), (901, [], 1), (902, [1.0] * 63, 1), (903, [1.0] * 65, 1), (904, [None] + [1.0] * 63, 1), (905, [NAN] + [1.0] * 63, 1), (906, [1.0] * 63 + [INF], 1), (None, [0.5] * 64, 2)]


@pytest.mark.parametrize("rows", [blobs(300), [(i, [float(i % 3)] * 64, 0) for i in range(60)], blobs(9), blobs(80) + blobs(80) + ODD, [(i, [i * 1e4 + 0.015625 * (i % 2)] * 64, 0) for i in range(40)]], ids=["blobs", "ties", "few", "repeated and odd", "large"])
def test_clusters(spark, rows):
    got = K.cluster_vectors(vectors(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == lloyd(rows)


def test_no_vectors(spark):
    assert K.cluster_vectors(vectors(spark, ODD[:7])).collect() == []
    assert K.cluster_vectors(vectors(spark, []), rounds=1).collect() == []


def test_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        K.cluster_vectors(vectors(spark, [(1, [1e9] * 64, 0)])).collect()


@pytest.mark.parametrize("size", [1, 50, 2_000, 10_000_000])
def test_intervals_hold_the_exact_score(size):
    r = np.random.default_rng(size)
    c, x = r.integers(-size, size + 1, (20, 64)), r.integers(-size, size + 1, (200, 64))
    c[3] = c[1]
    screen = K.Screen(c)
    low, high = screen.intervals(x)
    for i in range(len(x)):
        for n in range(len(c)):
            exact = sum(int(v) ** 2 for v in c[n]) - 2 * sum(int(a) * int(b) for a, b in zip(x[i], c[n], strict=True))
            assert low[i, n] <= exact <= high[i, n]
    at, d = screen.assign(x)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)), n) for n, w in enumerate(c)) for v in x]
    assert [(int(b), int(a)) for a, b in zip(at, d, strict=True)] == want


def mined(rows, every, positives=5, negatives=5):
    """The contract's rules on (vec_id, label, integers)."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a in sorted({r[0] for r in rows if r[0] % every == 0}):
        _, label, q = min(r for r in rows if r[0] == a)
        first = sorted((-dot(q, v), i) for i, lab, v in rows if lab == label and i != a)[:positives]
        others = sorted((-dot(q, v), i) for i, lab, v in rows if lab != label)
        for s, p in first:
            fit = [(n, i) for n, i in others if 80 * -s <= 100 * -n <= 100 * -s][:negatives]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def whole(rows, scale=16):
    return [(i, lab, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and usable(v, None)]


HARD = {
    "blobs": blobs(600, dim=8, kinds=5),
    "noise": blobs(500, dim=6, spread=3.0),
    "copies": [(i, [1.0, 2.0, 0.5], i % 3) for i in range(300)] + [(1000 + i, [1.0, 1.9, i / 50], i % 4) for i in range(100)],
    "opposite": [(i, [float((-1) ** i), 1.0 - i % 5], i % 2) for i in range(120)],
    "odd": blobs(250, dim=5) + blobs(60, dim=5) + [(2000, None, 1), (2100, [1.0], None), (2200, [None, 1.0], 1), (2300, [NAN, 1.0], 1), (2400, [], 1), (2500, [1.0], 1), (None, [1.0], 1), (2600, [INF], 0)],
    "one label": [(i, [1.0, i / 10], 4) for i in range(50)],
}


@pytest.mark.parametrize("name", sorted(HARD))
def test_hard_negatives(spark, name):
    rows = H.usable(vectors(spark, HARD[name]), 16)
    got = H.hard_negatives(rows, H.F.col("vec_id") % 10 == 0, block=64, anchor_block=7)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == mined(whole(HARD[name]), 10)


def test_no_rows(spark):
    assert H.hard_negatives(H.usable(vectors(spark, []), 16), H.F.col("vec_id") % 10 == 0).collect() == []
    assert H.hard_negatives(H.usable(vectors(spark, blobs(20)), 16), H.F.col("vec_id") < 0).collect() == []


def test_query_follows_the_contract(spark):
    data = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    plain = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows]
    assert sorted(tuple(r) for r in H.op12_hard_negatives(spark, data).collect()) == mined(plain, 100)


@pytest.mark.parametrize("size", [100, 2**24, 2**27])
def test_tree_prunes_and_stays_exact(size):
    """Tight, far balls are left out; products of any size are exact."""
    r = np.random.default_rng(5)
    mid = r.integers(-size, size, (12, 16))
    labels = np.arange(3000) % 12
    x = mid[labels] + r.integers(-size // 50, size // 50 + 1, (3000, 16))
    tree = H.BallTree(x, np.arange(3000), labels % 3, leaf=64)
    q, ql = x[:40], (labels % 3)[:40]
    exact = x.astype(object) @ q.T.astype(object)
    high = np.array([max(exact[:, i]) for i in range(40)], np.int64)
    low = high // 2
    for same in (True, False):
        tree.products = 0
        score, found = tree.best(q, np.arange(40), ql, low, high, 5, same)
        for i in range(40):
            fit = sorted((-exact[j, i], j) for j in range(3000) if (labels[j] % 3 == ql[i]) == same and not (same and j == i) and low[i] <= exact[j, i] <= high[i])[:5]
            assert [(-int(s), int(f)) for s, f in zip(score[i], found[i], strict=True) if f < H._LAST] == fit
        assert tree.products < 0.5 * len(q) * len(x)
    with pytest.raises(ValueError):
        H.BallTree(np.full((3, 4), 2**31), np.arange(3), np.zeros(3)).best(np.full((1, 4), 2**31), np.zeros(1), np.zeros(1), low[:1], high[:1], 5, True)
