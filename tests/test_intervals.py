"""Free runs, orphans and loudness against their plain rules."""

import random

import pytest

from lodestrata.operators import intervals as I

SPAN = "meeting_id long, seg_idx long, start_s double, end_s double, local_label string"


def spans(seed, n, length=100, grid=1.0, most=20):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a = r.randrange(int(length / grid)) * grid
        out.append((r.randrange(2), i, a, a + r.randrange(1, int(most / grid)) * grid, r.choice(["S01", "S02", "S03"])))
    return out


def longest_free(rows):
    """Every elementary piece between two borders, joined where nobody else talks."""
    out = {}
    for m, i, a, b, who in rows:
        other = [(x, y) for m2, _, x, y, w in rows if m2 == m and w != who and x < b and a < y and x <= y]
        cuts = sorted((max(a, x), min(b, y)) for x, y in other)
        best, cur = None, a
        for lo, hi in [*cuts, (b, b)]:
            if lo > cur and (best is None or lo - cur > best[1] - best[0]):
                best = (cur, lo)
            cur = max(cur, hi)
        out[m, i] = (*best, best[1] - best[0]) if best else (None, None, 0.0)
    return out


FIXED = [(0, 0, 0.0, 10.0, "A"), (0, 1, 2.0, 8.0, "B"), (0, 2, 3.0, 4.0, "A"), (0, 3, 8.0, 10.0, "B"), (0, 4, 20.0, 30.0, "A"), (0, 5, 20.0, 30.0, "B"), (0, 6, 30.0, 40.0, "A"), (1, 0, 5.0, 5.0, "A"), (1, 1, 9.0, 7.0, "A"), (1, 2, 0.0, 90_000.0, "B")]


@pytest.mark.parametrize("rows", [spans(1, 60), spans(2, 150, grid=0.5, most=60), FIXED], ids=["sparse", "dense", "nested, touching, empty, a day"])
@pytest.mark.parametrize("bucket", [7.0, 600.0, None])
def test_free_runs(spark, rows, bucket):
    got = {(r.meeting_id, r.seg_idx): (r.free_lo, r.free_hi, r.clean_s) for r in I.free_runs(spark.createDataFrame(rows, SPAN), bucket).collect()}
    assert got == longest_free(rows)


def test_embed_plan(spark):
    rows = [(0, 0, 0.0, 10.0, "A"), (0, 1, 4.0, 6.0, "B"), (0, 2, 20.0, 60.0, "A"), (0, 3, 70.0, 70.8, "A"), (0, 4, 95.0, 104.0, "B")]
    d = spark.createDataFrame(rows, SPAN).selectExpr("*", "0 AS win", "100.0D AS duration")
    plan = lambda alone: {r.seg_idx: (round(r.from_s, 2), round(r.to_s, 2), r.wanted) for r in I.embed_plan(d, d["duration"], alone).collect()}
    assert plan(False) == {0: (0.2, 9.8, True), 1: (4.2, 5.8, True), 2: (30.0, 50.0, True), 3: (70.2, 70.6, False), 4: (95.2, 100.0, True)}
    assert plan(True)[0] == (0.2, 3.8, True) and plan(True)[1] == (4.2, 5.8, True)  # nobody else is silent in 1: the span itself


def recovered(rows, duration):
    """The rule, one orphan after another. rows: meeting, idx, start, end, words, owned."""
    out = []
    for m in {r[0] for r in rows}:
        kept = {r[1]: r for r in rows if r[0] == m and r[5]}
        back = []
        for _, i, a, b, n, _ in sorted((r for r in rows if r[0] == m and not r[5]), key=lambda r: (r[2], r[1])):
            if not 0 <= a < b <= duration + 0.5:
                continue
            near = [k for k in kept.values() if k[2] < b and a < k[3]]
            if sum(min(b, k[3]) - max(a, k[2]) for k in near) >= 0.5 * (b - a):
                if sum(k[4] for k in near) >= 0.8 * n:
                    continue
                for k in near:
                    del kept[k[1]]
            if not any(x < b and a < y for _, x, y in back):
                back.append((i, a, b))
        out += [(m, k, False) for k in kept] + [(m, i, True) for i, _, _ in back]
    return sorted(out)


CORE = "meeting_id long, seg_idx long, start_s double, end_s double, n_words long, owned boolean"


@pytest.mark.parametrize("seed", range(6))
def test_recover_orphans(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(40 + 40 * (seed % 3)):
        a = r.randrange(0, 400) / 2 - 1
        rows.append((r.randrange(3), i, a, a + r.randrange(-1, 30) / 2, r.randrange(12), r.random() < 0.6))
    d = spark.createDataFrame(rows, CORE)
    got = I.recover_orphans(d, spark.createDataFrame([(m, 195.0) for m in range(3)], "meeting_id long, duration double"), bucket_s=[5.0, 60.0, None][seed % 3])
    assert sorted((x.meeting_id, x.seg_idx, x.recovered) for x in got.collect()) == recovered(rows, 195.0)


@pytest.mark.parametrize(
    ("kept", "orphans", "want"),
    [
        ([(0, 10, 20)], [(10.2, 11.0, 2)], ([0], [1])),  # a hole
        ([(0, 10, 20)], [(2, 4, 5)], ([0], [])),  # covered in seconds and words
        ([(0, 10, 2)], [(2, 9, 15)], ([], [1])),  # in seconds only: replaces
        ([], [(9.5, 11, 3), (9.6, 11.2, 3)], ([], [1])),  # the earlier of two
        ([(0, 10, 1)], [(0, 2, 0), (1, 9, 9), (8, 9.5, 9)], ([], [2])),  # no words are always told
        ([(0, 4, 1), (9, 12, 1)], [(1, 8, 50), (7, 12, 50)], ([0], [1])),  # rejected, and what it covers goes
    ],
)
def test_recovery_rules(spark, kept, orphans, want):
    rows = [(0, k, float(a), float(b), n, True) for k, (a, b, n) in enumerate(kept)] + [(0, len(kept) + k, float(a), float(b), n, False) for k, (a, b, n) in enumerate(orphans)]
    got = I.recover_orphans(spark.createDataFrame(rows, CORE)).collect()
    assert ([x.seg_idx for x in sorted(got) if not x.recovered], [x.seg_idx - len(kept) + 1 for x in sorted(got) if x.recovered]) == want


def test_no_orphans_and_no_kept(spark):
    d = spark.createDataFrame([(0, 0, 1.0, 2.0, 3, True)], CORE)
    assert [x.recovered for x in I.recover_orphans(d).collect()] == [False]
    assert I.recover_orphans(d.filter("NOT owned")).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_silence_gate(spark, seed):
    r = random.Random(seed)
    loud = {(m, r.randrange(5000)) for m in range(3) for _ in range(4 * 10**seed)}
    rows = [(r.randrange(3), i, a := r.randrange(45_000) / 10, a + r.randrange(20 * 10**seed) / 10, "A") for i in range(80)]
    frames = spark.createDataFrame([(m, f, 1.0) for m, f in loud] + [(0, f, 0.0) for f in range(50)], "meeting_id long, frame long, level double")
    got = sorted((x.meeting_id, x.seg_idx) for x in I.silence_gate(spark.createDataFrame(rows, SPAN), frames, 0.5, 1.0).collect())
    assert got == sorted((m, i) for m, i, a, b, _ in rows if any((m, f) in loud for f in range(int(a), int(b))))


def test_a_day_is_a_few_blocks(spark):
    """A meeting of 24 hours in frames of 10 ms: each span is at most 30 blocks of a size, and all joins carry the block."""
    day = 8_640_000
    d = spark.createDataFrame([(0, 0, 0.0, 86_400.0, "A"), (0, 1, 0.01, 86_399.99, "A"), (0, 2, 43_000.0, 43_030.0, "A")], SPAN)
    blocks = d.selectExpr("cast(start_s * 100 AS bigint) AS a", "cast(end_s * 100 AS bigint) AS b").select("a", "b", I.blocks_of(I.F.col("a"), I.F.col("b")).alias("x")).collect()
    for r in blocks:
        assert len(r.x) <= 30 * 7 and sum(16**x.level for x in r.x) == r.b - r.a and r.b <= day
        at = sorted((x.block * 16**x.level, (x.block + 1) * 16**x.level) for x in r.x)
        assert at[0][0] == r.a and at[-1][1] == r.b and all(p[1] == q[0] for p, q in zip(at, at[1:], strict=False))
    frames = spark.createDataFrame([(0, 43_010 * 100, 1.0)], "meeting_id long, frame long, level double")
    gate = I.silence_gate(d, frames, 0.5, 0.01)
    assert sorted(x.seg_idx for x in gate.collect()) == [0, 1, 2]
    plan = gate._jdf.queryExecution().optimizedPlan().toString()
    assert all("block" in line or "seg_idx" in line for line in plan.splitlines() if "Join" in line)


def test_gate_has_one_key_a_segment(spark):
    """Only the loud frames are repeated, once for each level that a segment needs; no segment is, and none is joined a second time."""
    d = spark.createDataFrame([(0, i, 97.0 * i, 97.0 * i + 29_000.0, "A") for i in range(50)], SPAN)
    gate = I.silence_gate(d, spark.createDataFrame([(0, 100_000 // 20, 1.0)], "meeting_id long, frame long, level double"), 0.5, 20.0)
    assert gate.count() == 0
    plan = gate._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.count("Join") == 1


def test_gate_at_the_ends_of_time(spark):
    """Spans over frame 0, of no end, and over borders of blocks; a repeated seg_idx stands for itself."""
    inf, nan = float("inf"), float("nan")
    rows = [(0, 0, -500.0, -100.0), (0, 1, -99.0, 1.0), (0, 2, -300.0, 70_000.0), (0, 3, -inf, -302.0), (0, 4, 256.0, 257.0), (0, 4, 257.0, 258.0), (0, 5, 65_535.0, 65_537.0)]
    rows += [(0, 6, 65_537.0, inf), (0, 7, 5.0, nan), (0, 8, nan, 9.0), (0, 9, -inf, inf), (0, 10, 3.0, -inf), (1, 11, -inf, inf), (None, 12, -inf, inf), (0, 13, 70_001.0, inf), (0, 14, None, 9.0)]
    d = spark.createDataFrame([(*r, "A") for r in rows], SPAN)
    frames = spark.createDataFrame([(0, f, 1.0) for f in (-301, 256, 65_536, 70_000)] + [(0, 0, 0.0), (1, 0, 0.0), (None, 0, 1.0)], "meeting_id long, frame long, level double")
    got = sorted((r.seg_idx, r.start_s, r.end_s) for r in I.silence_gate(d, frames, 0.5, 1.0).select("seg_idx", "start_s", "end_s").fillna(-1.0).collect())
    assert [r[0] for r in got] == [0, 2, 4, 5, 6, 7, 9] and got[2][1] == 256.0
