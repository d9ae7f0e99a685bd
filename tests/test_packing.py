"""Batches of a distributed fold against the plain one."""

import random

import pytest

from lodestrata.operators.packing import pack, pool_windows
from lodestrata.operators.recovery import pack_batches


@pytest.mark.parametrize(("n", "part_rows", "most", "spread", "kind"), [(500, 40, 32, 1.15, "even"), (500, 7, 32, 1.05, "even"), (300, 20, 5, 3.0, "ties"), (200, 1000, 32, 1.15, "even"), (200, 9, 1, 1.0, "ties"), (300, 3, 16, 1e9, "even"), (1, 5, 4, 1.1, "even"), (0, 5, 4, 1.1, "even")])
def test_pack(spark, n, part_rows, most, spread, kind):
    r = random.Random(n + part_rows)
    lengths = [float(r.randrange(4)) if kind == "ties" else r.random() * 20 for _ in range(n)]
    d = spark.createDataFrame(list(enumerate(lengths)), "id long, length double").repartition(3)
    got = pack(d, most, spread, part_rows)
    want = {i: k for k, b in enumerate(pack_batches(lengths, most, spread)) for i in b}
    assert {x.id: x.batch for x in got.collect()} == want


def test_limits(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], "id long, length double"), most=0)


def flushed(recordings, target, most_s):
    """One window after another, as a queue is worked on."""
    out, pool, left, audio, held, n = [], [], {}, 0.0, {}, 0

    def flush():
        nonlocal pool, audio, n
        if not pool:
            return
        for r, _ in pool:
            left[r] -= 1
        done = [r for r in left if left[r] == 0]
        for r in done:
            audio -= held.pop(r, 0.0)
            del left[r]
        out.append((n, pool, done))
        pool, n = [], n + 1

    for r, windows, seconds in recordings:
        if not windows:
            continue
        left[r] = windows
        for w in range(windows):
            pool.append((r, w))
            if len(pool) >= target:
                flush()
        if r in left:
            audio += seconds
            held[r] = seconds
        if audio >= most_s:
            flush()
    flush()
    return out


@pytest.mark.parametrize(("target", "most_s"), [(8, 1e9), (32, 300.0), (5, 120.0), (1, 10.0), (1000, 1e9)])
def test_pool_windows(spark, target, most_s):
    r = random.Random(target)
    queues = {q: [(i, r.choice([0, 1, 2, 7, 30]), r.uniform(1, 200)) for i in range(25)] for q in range(3)}
    rows = [(q, i, k, n, s) for q, rec in queues.items() for k, (i, n, s) in enumerate(rec)]
    got = {}
    for x in pool_windows(spark.createDataFrame(rows, "queue int, recording long, place int, n_windows long, duration double"), target, most_s).collect():
        got.setdefault((x.queue, x.batch), []).append(x)
    for q, rec in queues.items():
        want = flushed(rec, target, most_s)
        assert sorted(b for k, b in got if k == q) == [n for n, _, _ in want]
        for n, pool, done in want:
            have = got[q, n]
            assert sorted((x.recording, w) for x in have for w in range(x.first, x.last + 1)) == sorted(pool)
            assert sorted(x.recording for x in have if x.completes) == sorted(done)
