"""The numpy kernels and sequential rules against plain statements of their rules."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.operators import clustering as C
from lodestrata.operators import recovery as R


def naive_linkage(s, block):
    groups = {i: [i] for i in range(len(s))}
    out = []
    while True:
        best = None
        for i in sorted(groups):
            for j in sorted(groups):
                if i < j and not block[np.ix_(groups[i], groups[j])].any():
                    m = s[np.ix_(groups[i], groups[j])].mean()
                    if best is None or m > best[0] + 1e-12:
                        best = (m, i, j)
        if best is None:
            return out
        m, i, j = best
        out.append((i, j, m))
        groups[i] += groups.pop(j)


def case(seed, n, density):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    b = np.triu(r.random((n, n)) < density, 1)
    return v @ v.T, b | b.T


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 17, 33])
@pytest.mark.parametrize("density", [0.0, 0.15, 0.45])
@pytest.mark.parametrize("seed", [0, 1])
def test_linkage_equals_naive(seed, n, density):
    s, b = case(seed, n, density)
    got, want = C.linkage(s, b), naive_linkage(s, b)
    assert [(i, j) for i, j, _ in got] == [(i, j) for i, j, _ in want]
    assert np.allclose([h for *_, h in got], [h for *_, h in want])


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 20), st.floats(0, 0.5), st.floats(-1, 1))
def test_no_parted_pair_shares_a_cluster(seed, n, density, cut):
    s, b = case(seed, n, density)
    sec = np.random.default_rng(seed).uniform(1, 30, n)
    labels = C.labels_at(n, C.linkage(s, b), cut)
    for step in (lambda x: x, lambda x: C.absorb(x, s, sec, b, 10), lambda x: C.refine(x, s, b), lambda x: C.repair(x, sec, b)):
        labels = step(labels)
        assert not (b & (labels[:, None] == labels[None, :])).any()


def test_repair_moves_the_shorter():
    b = np.zeros((3, 3), bool)
    b[0, 1] = b[1, 0] = True
    assert C.dense(C.repair(np.array([0, 0, 0]), np.array([9.0, 3.0, 5.0]), b)).tolist() == [0, 1, 0]
    assert C.repair(np.array([0, 0, 0]), np.full(3, 5.0), b).tolist() == [1, 0, 0]  # of equals the earlier


@pytest.mark.parametrize("seed", range(12))
def test_absorb_and_refine_go_by_unit_centroids(seed):
    """Held against the rule stated with vectors instead of dot products."""
    r = np.random.default_rng(seed)
    v = r.normal(size=(14, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s, labels, sec, none = v @ v.T, r.integers(0, 4, 14), r.uniform(1, 6, 14), np.zeros((14, 14), bool)
    unit = lambda x: x / np.linalg.norm(x)
    want = labels.copy()
    while True:
        tot = {c: sec[want == c].sum() for c in np.unique(want)}
        small = sorted((t, c) for c, t in tot.items() if t < 12)
        if not small or len(tot) < 2:
            break
        c = small[0][1]
        want[want == c] = max((o for o in tot if o != c), key=lambda o: unit(v[want == c].mean(0)) @ unit(v[want == o].mean(0)))
    assert C.absorb(labels, s, sec, none, 12).tolist() == want.tolist()
    want = labels.copy()
    for _ in range(3):
        for i in range(14):
            if (want == want[i]).sum() > 1:
                others = np.arange(14) != i
                want[i] = max(np.unique(want), key=lambda c: v[i] @ unit(v[(want == c) & others].sum(0)))
    assert C.refine(labels, s, none).tolist() == want.tolist()


def test_weak_atoms():
    v = np.eye(3)[[0, 1, 0, 2]] * 1.0
    v[3] = [0.9, 0.1, np.sqrt(1 - 0.82)]
    s, win, local = v @ v.T, np.array([0, 0, 1, 0]), np.array(["A", "B", "A", "C"])
    labels, info = C.cluster(s, win, local, np.array([20.0, 20.0, 20.0, 1.0]))
    assert labels.tolist() == [0, 1, 0, -1] and info["floor"] == 2 and info["floor_ok"]  # its window has A's voice under another label; B isn't near
    labels, _ = C.cluster(s, np.array([0, 0, 1, 2]), local, np.array([20.0, 20.0, 20.0, 1.0]))
    assert labels.tolist() == [0, 1, 0, 0]
    assert C.cluster(s, win, local, np.zeros(4))[0].tolist().count(-1) == 2  # only the longest is core; another window has its voice


def test_gap_threshold():
    assert C.gap_threshold([0.5])[0] == 0.2656
    cut, span, lead = C.gap_threshold([0.9, 0.8, 0.2, 0.1])
    assert (round(cut, 6), round(span, 6), round(lead, 6)) == (0.5, 0.8, 6.0)
    assert C.low_separation(0.2, 9.0) and C.low_separation(0.9, 1.5) and not C.low_separation(0.3, 2.0)


def test_cover_starts_at_longest_and_reaches():
    v = np.eye(4)
    got = C.cover(v, np.arange(4), np.array([1.0, 9.0, 2.0, 3.0]))
    assert got[0] == 1 and sorted(got) == [0, 1, 2, 3]
    assert C.cover(np.repeat(v[:1], 3, 0), np.zeros(3), np.ones(3)) == [0]
    assert C.cover(v[:0], np.zeros(0), np.zeros(0)) == []


def test_seams_trim_against_the_trimmed():
    assert R.trim_seams(["a b c d", "b c d e f g"], [0, 1]) == ["a b c d", "e f g"]
    assert R.trim_seams(["a b c d", "b c d e"], [0, 0]) == ["a b c d", "b c d e"]
    assert R.trim_seams(["x A, b. c", "a b c"], [0, 1])[1] == "a b c"  # the whole text never goes


def test_window_plan():
    assert [w[2:] for w in R.plan_windows(65.0)] == [(0.0, 30.0), (30.0, 60.0), (60.0, 65.0)]
    assert [w[2:] for w in R.plan_windows(60.5)] == [(0.0, 30.0), (30.0, 60.0)]
    assert R.plan_windows(0.9) == [] and len(R.plan_windows(1.0)) == 1
    assert R.plan_windows(60.0, overlap=5)[1] == (25.0, 60.0, 30.0, 60.0)
    levels = np.ones(5000)
    levels[1450] = 0
    first, second, *_ = R.plan_windows(60.0, levels=levels, snap=2.0)
    assert first == pytest.approx((0.0, 30.0, 0.0, 29.01))  # a full window, cut in the middle of the frame
    assert second[:3:2] == pytest.approx((29.01, 29.01))


def test_batches():
    assert R.pack_batches([1.0, 1.1, 1.2, 5.0]) == [[0, 1], [2], [3]]
    assert [len(b) for b in R.pack_batches([1.0] * 70)] == [32, 32, 6]


def test_claims_are_one_to_one():
    score = np.array([[0.9, 0.7], [0.95, 0.8], [0.7, 0.1]])
    a = R.Assigner(np.eye(3), score, np.array([0, 0, 1]), np.full(3, 5.0), np.arange(3), np.eye(3), np.eye(3)[:2], np.array([0, 1]))
    a.claims()
    assert a.name.tolist() == [1, 0, 0]


def voices(seed, n, d=16, people=5):
    """Labels, unit vectors (the second half copies of the first), windows of three labels, seconds."""
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d))
    v[n // 2 :] = v[: n - n // 2]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    i = np.arange(n)
    return r.integers(0, people, n), v, i // 3, np.array([f"S{k % 3}" for k in i]), r.choice([1.0, 3.0, 7.0, 20.0], n)


@pytest.mark.parametrize("seed", range(12))
def test_linkage_of_copies_goes_by_row_order(seed):
    """Averages that are equal but for rounding are equal: of them the first pair wins."""
    label, v, win, local, sec = voices(seed, 21, 4, 1)
    x = C.factors(label, v)
    apart = C.cannot(win, local, sec, 6.0, 10)
    block = np.array([[j in row for j in range(21)] for row in apart])
    assert [m[:2] for m in C.linkage((x, x), apart)] == [m[:2] for m in naive_linkage(x @ x.T, block)]


@pytest.mark.parametrize("seed", range(3))
def test_factors_and_matrix_give_one_result(seed):
    label, v, win, local, sec = voices(seed, 90)
    x = C.factors(label, v)
    s = x @ x.T
    assert C.cluster((x, x), win, local, sec)[0].tolist() == C.cluster(s, win, local, sec)[0].tolist()
    assert C.linkage((x, x), [[]] * 90)[-1][:2] == C.linkage(s, [[]] * 90)[-1][:2]


def test_a_long_meeting_takes_memory_by_its_rows():
    """3,000 atoms: a matrix of their pairs alone would be 72 MB."""
    import tracemalloc

    label, v, win, local, sec = voices(0, 3000)
    x = C.factors(label, v)
    tracemalloc.start()
    labels, _ = C.cluster((x, x), win, local, sec)
    C.plain_cluster(x, sec, 0.2656)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(labels) == 3000 and most < 45e6


def test_estimates_hold_no_matrix(monkeypatch):
    """The largest gap found from a Krylov space is that of all eigenvalues, and memory grows with the rows."""
    import tracemalloc

    label, v, *_ = voices(1, 2500)
    x = C.factors(label, v)
    want = C.eigengap(x[:700] @ x[:700].T), C.silhouette_k(x[:700] @ x[:700].T)
    tracemalloc.start()
    C.eigengap((x, x)), C.silhouette_k((x, x))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6  # a matrix: 50 MB
    monkeypatch.setattr(C, "_DENSE", 100)
    assert (C.eigengap((x[:700], x[:700])), C.silhouette_k((x[:700], x[:700]))) == want


def test_cover_of_many_members_holds_no_matrix():
    import tracemalloc

    label, v, _, _, sec = voices(2, 3000)
    tracemalloc.start()
    got = C.cover(v, label, sec)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == len(set(got)) == 24 and most < 10e6  # a matrix: 72 MB


def test_naming_from_factors_equals_that_from_a_matrix():
    for seed in range(6):
        r = np.random.default_rng(seed)
        _, v, win, _, sec = voices(seed, 80, 4)
        bank, owner = v[:3], np.arange(3)
        args = v @ bank.T, win, sec, np.arange(80), v, bank, owner
        assert R.Assigner((v, v), *args).run() == R.Assigner(v @ v.T, *args).run()
