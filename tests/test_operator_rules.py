"""Rules of single operators against plain statements of them."""

import random
import re
import statistics
from collections import defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestrata.operators import assembly, clustering as C
from lodestrata.operators import cuts, linking, matching, recovery, reports, selection
from lodestrata.sources import tables as S

DATA = "/root/testdata/sf0.001"


def repaired(text, default="S01"):
    """Token by token."""
    out, last, at, n = "", None, 0, 0
    for m in re.finditer(r"\[([^\]]*)\]", text):
        out += text[at : m.end()]
        at = m.end()
        if re.fullmatch(r"S\d+", m[1]):
            last = m[1]
        elif re.fullmatch(r"\d+(?:\.\d+)?", m[1]):
            last = last or default
            rest = text[at:].lstrip()
            if rest and rest[0] != "[":
                out, n = f"{out}[{last}]", n + 1
    return out + text[at:], n


TEXTS = ["[0]hi[1][1][S02]yo[2][2]so[3]", "", " ", "no tags", "[0.5] hi [1]", "[0]hi[1] and on", "[0][S3] a [x] b [1]\n[1.5]  c[2", "[[0]a]b[1]", "[0] [1]", "[S01][0]a[1][0.]b[1]", "a[", "[S02]", "[1]x[S04][2]y", "[٣]z[4]", "[0]日本[1][S10] ["]


def test_tags(spark):
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice(["[", "]", "[1]", "[2.5]", "[S01]", "[S22]", " ", "a", "bc", "\n", "[x]"]) for _ in range(r.randrange(14))) for _ in range(300)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string")
    got = {x.i: (x.text, x.n_repaired) for x in recovery.repair_generations(d).collect()}
    assert got == {i: repaired(t) for i, t in enumerate(texts)} | {len(texts): (None, None)}


def test_retry_repairs_first(spark):
    d = spark.createDataFrame([(0, "[0.5]hello there[1.5]"), (1, "hello"), (2, " \n"), (3, "[1][S01]a[2]"), (4, None), (5, "[S01] a [1]")], "win int, text string")
    assert sorted(x.win for x in selection.to_retry(d).collect()) == [1, 5]


def test_speech_end_of_silence(spark):
    f = spark.createDataFrame([(0, 10, -20.0), (0, 30, -90.0), (1, 4, -90.0), (1, 199, -80.0)], "meeting_id int, frame long, db double")
    assert {x.meeting_id: round(x.speech_end, 2) for x in selection.speech_end(f).collect()} == {0: 0.1, 1: 2.0}
    known = spark.createDataFrame([(0, 0.5), (1, 2.004), (2, 9.0)], "meeting_id int, duration double")
    assert {x.meeting_id: round(x.speech_end, 3) for x in selection.speech_end(f, durations=known).collect()} == {0: 0.1, 1: 2.004, 2: 9.0}


def test_the_speech_end_query_holds_both_cases(spark):
    from lodestrata.plans import catalog

    loud = {x.meeting_id for x in catalog._levels(spark, DATA).filter("db >= 40").select("meeting_id").distinct().collect()}
    assert 0 < len(loud) < spark.read.parquet(f"{DATA}/events.parquet").select("user_id").distinct().count()


def test_channel_median_is_the_majoritys(spark):
    rows = [(1, "narrowband", 1.0), (1, "narrowband", 3.0), (1, "wideband", 100.0), (2, "wideband", 5.0), (2, "narrowband", 7.0)]
    got = {x.user_id: (x.kind, x.agreement, x.median_value) for x in reports.channel_vote(spark.createDataFrame(rows, "user_id int, event_type string, value double")).collect()}
    assert got == {1: ("narrowband", 0.666667, 2.0), 2: ("narrowband", 0.5, 7.0)}


def test_resolve(spark):
    m = spark.createDataFrame([("ab12", "one-trust-ab12", "One Trust"), ("cd34", "one-trust-cd34", "One Trust"), ("ef56", "board-ef56", "Board Talk"), ("board", "other-board", "x")], "meeting_id string, folder string, title string").withColumn("path", F.concat(F.lit("/lib/"), "folder"))
    want = {"ab12": "ab12", "one-trust-cd34": "cd34", "one-trust": None, "TRUST-AB": "ab12", "board": "board", "Board T": "ef56", "talk": "ef56", "one": None, "nothing": None, " ef56/ ": "ef56", "/lib/board-ef56/": "ef56", "": None}
    got = reports.resolve(m, spark.createDataFrame([(k,) for k in want], "ref string"))
    assert {x.ref: x.meeting_id for x in got.collect()} == want


def test_labels_need_their_segments(spark):
    s = spark.createDataFrame([(1, 0, "S01", 0)], "meeting_id int, win int, local_label string, seg_idx int")
    labels = spark.createDataFrame([(1, 0, "S01", "G00", 1), (1, 7, "S02", "G01", 2)], "meeting_id int, win int, local_label string, label string, n_segments int")
    with pytest.raises(PySparkException, match="differ in number at 1 7 S02"):
        selection.labels_to_segments(s, labels).collect()
    with pytest.raises(PySparkException, match="differ in number"):
        selection.labels_to_segments(s.filter("false"), labels).collect()


def assigner(v, win, sec):
    v = np.array(v, float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    a = recovery.Assigner(v @ v.T, np.zeros((len(v), 0)), np.array(win), np.array(sec, float), np.arange(len(v)), v, v[:0], np.zeros(0, int))
    a.rep = np.arange(len(v))
    return a


def test_merged_identities_keep_their_windows():
    """o takes x in, which speaks in window 2; n, of window 2 too, may not take o from it."""
    o, x, n = [1, 0, 0], [0.8, 0.6, 0], [0.8, -0.3, 0.52]
    a = assigner([o, x, n], [1, 2, 2], [30, 20, 10])
    a.pooled_merging()
    assert a.rep.tolist() == [0, 0, 2]
    a = assigner([o, x, n], [1, 2, 3], [30, 20, 10])  # without the clash o takes both
    a.sim[:] = 1
    a.pooled_merging()
    assert a.rep.tolist() == [0, 0, 0]


@pytest.fixture(scope="module")
def linked(spark):
    """Real merges of every meeting, and each meeting's ids and heights."""
    atoms = S.atoms(spark, DATA)
    merges = C.merge_steps(atoms).cache()
    rows = sorted((r.meeting_id, r.step, r.a, r.b, r.height) for r in merges.collect())
    ids = defaultdict(list)
    for r in atoms.select("meeting_id", "vec_id").collect():
        ids[r.meeting_id].append(r.vec_id)
    return atoms.select("meeting_id", F.col("vec_id").alias("node")), merges, rows, {m: sorted(v) for m, v in ids.items()}


def test_gap_cuts_equal_the_kernel(spark, linked):
    _, merges, rows, _ = linked
    for r in cuts.gap_cuts(merges).collect():
        want = C.gap_threshold([h for m, *_, h in rows if m == r.meeting_id])
        assert (r.threshold, r.span, r.dominance) == pytest.approx(want) and r.low_separation == C.low_separation(*want[1:])
    few = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.1)], "meeting_id int, step int, height double")
    assert tuple(cuts.gap_cuts(few).first()) == (1, 0.2656, 0.0, 0.0, True)


@pytest.mark.parametrize("cut", [None, 2.0, 0.3, -5.0])
def test_labels_at_equal_the_kernel(spark, linked, cut):
    nodes, merges, rows, ids = linked
    at = cuts.gap_cuts(merges) if cut is None else nodes.select("meeting_id", F.lit(cut).alias("threshold")).distinct()
    thr = {r.meeting_id: r.threshold for r in at.collect()}
    got = {(r.meeting_id, r.node): r.label for r in cuts.labels_at(nodes, merges, at).collect()}
    for m, nodes_ in ids.items():
        place = {n: k for k, n in enumerate(nodes_)}
        want = C.labels_at(len(nodes_), [(place[a], place[b], h) for m2, _, a, b, h in rows if m2 == m], thr[m])
        assert [got[m, n] for n in nodes_] == want.tolist()


def test_replay_stops_at_the_first_lower_merge(spark):
    nodes = spark.createDataFrame([(1, k) for k in range(200)] + [(2, 5)], "meeting_id int, node int")
    merges = spark.createDataFrame([(1, k, 198 - k, 199 - k, 0.9 if k != 100 else 0.1) for k in range(199)], "meeting_id int, step int, a int, b int, height double")
    at = spark.createDataFrame([(1, 0.5), (2, 0.5)], "meeting_id int, threshold double")
    got = {(r.meeting_id, r.node): r.label for r in cuts.labels_at(nodes, merges, at).collect()}
    assert got == {(1, k): min(k, 99) for k in range(200)} | {(2, 5): 0}


def test_confusion(spark):
    r = random.Random(4)
    seg = [(m := r.randrange(2), i // 6, f"S0{r.randrange(3)}", a := float(r.randrange(100)), a + r.randrange(1, 12)) for i in range(50)]
    gids = {k: r.choice(["G00", "G01", None]) for k in sorted({s[:3] for s in seg})}
    ref = [(r.randrange(2), r.choice("ABC"), a := float(r.randrange(90)), a + r.randrange(1, 15)) for _ in range(14)]
    over, time = defaultdict(lambda: defaultdict(float)), defaultdict(float)
    for m, w, loc, a, b in seg:
        time[m, w, loc] += b - a
        for m2, sp, x, y in ref:
            if m == m2 and min(b, y) > max(a, x):
                over[m, w, loc][sp] += min(b, y) - max(a, x)
    cell, off, pure = defaultdict(float), defaultdict(float), defaultdict(list)
    for k, gid in gids.items():
        o, row = over[k], (k[0], gid or "UNASSIGNED")
        if o:
            best = min(o, key=lambda s: (-o[s], s))
            cell[*row, best] += sum(o.values())
            pure[k[0]].append(o[best] / sum(o.values()))
        off[row] += max(0.0, time[k] - sum(o.values()))
    d = spark.createDataFrame([(*s, gids[s[:3]]) for s in seg], "meeting_id int, win int, local_label string, start_s double, end_s double, gid string")
    t = spark.createDataFrame(ref, "meeting_id int, speaker string, start_s double, end_s double")
    v = reports.voices_against(d, t, bucket_s=10.0)
    cells = reports.confusion_cells(v).cache()
    got = cells.collect()
    assert {(c.meeting_id, c.gid, c.speaker): round(c.seconds, 6) for c in got if c.gid and c.speaker} == {k: round(x, 6) for k, x in cell.items()}
    assert {(c.meeting_id, c.gid): round(c.off_s, 6) for c in got if c.gid and not c.speaker} == {k: round(x, 6) for k, x in off.items()}
    for m in {k[0] for k in gids}:
        assert [c.seconds for c in got if c.meeting_id == m and not c.gid and not c.speaker] == pytest.approx([sum(x for k, x in cell.items() if k[0] == m)])
    for p in reports.cluster_purity(cells).collect():
        row = {k[2]: x for k, x in cell.items() if k[:2] == (p.meeting_id, p.gid)}
        if row:
            assert (p.purity, p.top) == (pytest.approx(max(row.values()) / sum(row.values())), min(row, key=lambda s: (-row[s], s)))
        else:
            assert p.purity is None and p.top is None and p.off_s > 0
    for s in reports.speaker_recall(cells, t).collect():
        col = {k[1]: x for k, x in cell.items() if (k[0], k[2]) == (s.meeting_id, s.speaker)}
        assert s.ref_s == pytest.approx(sum(y - x for m, sp, x, y in ref if (m, sp) == (s.meeting_id, s.speaker)))
        assert s.captured == pytest.approx(sum(col.values()))
        assert (s.best_cluster, s.best_frac) == ((min(col, key=lambda g: (-col[g], g == "UNASSIGNED", g)), pytest.approx(max(col.values()) / sum(col.values()))) if col else (None, 0.0))
    for x in reports.local_purity(v).collect():
        p = pure[x.meeting_id]
        assert (x.mean, x.median, x.below) == pytest.approx((statistics.mean(p), statistics.median(p), sum(q < 0.8 for q in p) / len(p)))


@pytest.mark.parametrize(("n", "block", "least"), [(120, 16, 0.75), (120, 1000, 0.6), (60, 7, 0.2), (40, 9, 2.0)])
def test_similar_groups_are_the_components_of_the_pairs(spark, n, block, least):
    r = np.random.default_rng(n)
    v = r.normal(size=(n, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    d = spark.createDataFrame([(i * 3, int(r.integers(4)), x.tolist()) for i, x in enumerate(v)], "id long, label int, v array<double>")
    pairs = linking.similar_pairs(d, least, block)
    want = {x.node: x.label for x in linking.connected(pairs).collect()}
    assert {x.node: x.label for x in linking.similar_groups(d, least, block).collect()} == want


def test_a_dense_group_is_not_listed_in_pairs():
    """Of 300 rows that are all alike at most one row each is told."""
    x = np.arange(300)
    node, label = linking._forest(x, x.copy(), np.ones((300, 300), bool) & (x[:, None] != x[None, :]))
    assert len(set(zip(node.tolist(), label.tolist(), strict=True))) == 299 and set(label.tolist()) == {0}
    chain = np.abs(x[:, None] - x[None, :]) == 1
    node, label = linking._forest(x, x.copy(), chain)
    assert set(label.tolist()) == {0} and len(node) == 598


@pytest.mark.parametrize("seed", range(3))
def test_claims_are_stable(spark, seed):
    r = random.Random(seed)
    rows = [(0, i // 4, i, p, round(r.uniform(0.5, 0.9), 1 + seed)) for i in range(40) for p in range(5)]
    d = spark.createDataFrame(rows, "meeting_id long, win long, vec_id long, person int, sim double")
    want, atoms, people = set(), set(), set()
    for m, w, v, p, s in sorted(rows, key=lambda x: (-x[4], x[2], x[3])):
        if s >= 0.62 and v not in atoms and (w, p) not in people:
            atoms.add(v)
            people.add((w, p))
            want.add((m, v, p, s))
    assert {tuple(x) for x in matching.one_to_one(d).collect()} == want


# --- the arms without constraints ---


def voices(k, each, spread, seed=0, dim=12):
    r = np.random.default_rng(seed)
    mid = np.eye(dim)[:k]
    v = np.repeat(mid, each, 0) + r.normal(scale=spread, size=(k * each, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("k", [2, 4, 7])
def test_estimates_of_k(k):
    v = voices(k, 9, 0.12)
    assert C.eigengap(v @ v.T) == k and C.silhouette_k(v @ v.T) == k
    d = np.clip(1 - v @ v.T, 0, 2)
    labels = np.repeat(np.arange(k), 9)
    labels[0] = k  # one on its own
    want = []
    for i in range(len(v)):
        own = [d[i, j] for j in range(len(v)) if j != i and labels[j] == labels[i]]
        other = [np.mean(d[i, labels == c]) for c in set(labels.tolist()) - {labels[i]}]
        want.append((min(other) - np.mean(own)) / max(min(other), np.mean(own)) if own else 0.0)
    np.fill_diagonal(d, 0)
    assert C.silhouette(d, labels) == pytest.approx(np.mean(want))


def test_estimates_of_little():
    assert C.eigengap(np.ones((1, 1))) == 1 and C.silhouette_k(np.ones((2, 2))) is None
    assert C.silhouette_k(np.ones((5, 5))) is None  # all merges at one height: never two clusters


def test_plain_cluster():
    v = np.concatenate([voices(3, 6, 0.1), [voices(3, 1, 0.0)[2], np.zeros(12)]])
    sec = np.array([5.0] * 18 + [1.0, 1.0])
    assert C.plain_cluster(v, sec, 0.4).tolist() == [0] * 6 + [1] * 6 + [2] * 6 + [2, -1]
    assert C.plain_cluster(v, np.zeros(20), 0.4).tolist() == [-1] * 20
    moved = v.copy()
    moved[0] = [0.4, 0.6] + [0.0] * 10
    moved[0] /= np.linalg.norm(moved[0])
    assert C.plain_cluster(moved, sec, 0.75)[0] == C.plain_cluster(moved, sec, 0.75)[6]  # reassigned to the nearer centroid


def test_arms_over_meetings(spark):
    a = S.atoms(spark, DATA).filter("meeting_id < 3")
    est = {r.meeting_id: r for r in C.estimate_k(a).collect()}
    assert set(est) == {0, 1, 2} and all(1 <= e.by_gap <= 15 and 2 <= e.by_silhouette <= 15 and 18 <= e.n <= 20 for e in est.values())
    got = C.plain_clusters(a, 0.3)
    assert got.count() == 60 and got.filter("cluster < 0").isEmpty()
    cents = C.final_centroids(a, C.cluster_meetings(a))
    sure = {(r.meeting_id, r.vec_id): r.cluster for r in C.cluster_meetings(a).filter("cluster >= 0").collect()}
    for c in cents.collect():
        own = [r for r in a.collect() if sure.get((r.meeting_id, r.vec_id)) == c.cluster and r.meeting_id == c.meeting_id]
        v = sum(r.sec * np.array(r.v) for r in own)
        assert (c.n, c.seconds) == (len(own), sum(r.sec for r in own)) and c.v == pytest.approx(v / np.linalg.norm(v))


def test_seams_of_a_relation(spark):
    """Word by word: what a text repeats from the end of the trimmed one before it, 3 to 10 words, goes."""
    r = random.Random(8)
    rows, want = [], {}
    for m in range(6):
        before = None
        for w in range(12):
            words = [r.choice(["a", "B", "c.", "d,"]) for _ in range(r.randrange(0, 14))]
            if before and r.random() < 0.6:
                words = [x.upper() if r.random() < 0.3 else x for x in before[-r.randrange(1, 12) :]] + words
            rows.append((m, w, " ".join(words)))
            kept = words
            if before is not None:
                plain = lambda x: x.lower().strip(".,?!")
                for n in range(10, 2, -1):
                    if n <= len(before) and n < len(words) and all(plain(x) == plain(y) for x, y in zip(before[-n:], words[:n], strict=True)):
                        kept = words[n:]
                        break
            want[m, w] = " ".join(kept)
            before = kept
    r.shuffle(rows)
    got = recovery.trim_seams_of(spark.createDataFrame(rows, "meeting_id long, win long, text string"))
    assert {(x.meeting_id, x.win): x.text for x in got.collect()} == want and sum(len(t.split()) for _, _, t in rows) > sum(len(t.split()) for t in want.values())


def test_seams_of_many_meetings_in_one_task(spark):
    """Meetings pass through a task in order; each begins anew, and none is a group of its own."""
    rows = [(m, w, t) for m in range(60) for w, t in enumerate(["a b c d", "b c d e f g", "e f g h"])]
    d = recovery.trim_seams_of(spark.createDataFrame(rows, "meeting_id long, win long, text string"))
    assert sorted(map(tuple, d.collect())) == [(m, w, t) for m in range(60) for w, t in enumerate(["a b c d", "e f g", "h"])]
    assert "FlatMapGroups" not in d._jdf.queryExecution().toString()


@pytest.mark.parametrize("size, snap, hop", [(30.0, 5.0, 2.0), (30.0, 5.0, 0.02), (30.0, 0.0, 2.0), (7.3, 2.1, 0.5), (3.0, 7.0, 0.25)])
def test_snapped_windows_equal_the_plan(spark, size, snap, hop):
    r = np.random.default_rng(7)
    rows, want = [], []
    for m in range(6):
        at = np.sort(r.choice(2000, 40 * m + 1, replace=False))
        db = np.round(r.choice([-120.0, -60.0, 3.0], len(at)) + r.random(len(at)), 3)
        rows += [(m, int(f), float(x)) for f, x in zip(at, db, strict=True)]
        levels = np.full(int(at[-1]) + 1, -120.0)
        levels[at] = db
        want += [(m, k, *w) for k, w in enumerate(recovery.plan_windows(len(levels) * hop, size, levels=levels, snap=snap, hop=hop))]
    got = recovery.snapped_windows(spark.createDataFrame(rows, "meeting_id long, frame long, db double"), size, snap, hop)
    assert sorted(map(tuple, got.collect())) == want


def test_silence_takes_no_memory(spark):
    """An hour's frame far behind the others: what lies between is not laid out frame by frame."""
    d = spark.createDataFrame([(1, 3, 5.0), (1, 10**12, 5.0)], "meeting_id long, frame long, db double")
    got = recovery.snapped_windows(d, size=1e9, snap=5.0, hop=2.0).count()
    assert 2000 <= got <= 2001


def test_windows_of_silence_take_little_disk(spark, tmp_path):
    """Meetings that are silent for thousands of windows: the windows are the plan's, and files of them take less than two bytes each."""
    r = np.random.default_rng(5)
    rows, want = [], []
    for m in range(300):
        at = [int(x) for x in sorted({*r.integers(9, 60, 2 * (m % 30 == 1)), *r.integers(16_000, 18_000, 2)})]
        rows += [(m, f, 5.0) for f in at]
        if m % 20 < 3:
            levels = np.full(at[-1] + 1, -120.0)
            levels[at] = 5.0
            want += [(m, k, *w) for k, w in enumerate(recovery.plan_windows(len(levels) * 2.0, 30.0, levels=levels, snap=5.0, hop=2.0))]
    recovery.snapped_windows(spark.createDataFrame(rows, "meeting_id long, frame long, db double").coalesce(1), 30.0, 5.0, 2.0).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.filter("meeting_id % 20 < 3").collect())) == want and len(want) > 45 * 1024
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 2 * got.count()


def test_overlaps_of_long_spans_make_few_rows(spark):
    """Spans of a day: a row for each hour of them would be 25 a span. A reversed span counts as the comparison says."""
    rows = [(1, i, 86400.0 * i / 7, 86400.0 * (i / 7 + 1), "ab"[i % 2]) for i in range(30)] + [(1, 99, 90000.0, 80000.0, "c")]
    d = assembly.speaker_overlaps(spark.createDataFrame(rows, "meeting_id long, seg_idx long, start_s double, end_s double, local_label string"))
    want = [(a[1], b[1], round(min(a[3], b[3]) - max(a[2], b[2]), 6)) for a in rows for b in rows if a[4] != b[4] and a[2] < b[3] and b[2] < a[3]]
    assert sorted((r.seg_idx, r.other_idx, round(r.seconds, 6)) for r in d.collect()) == sorted(want)
    plan = d._jdf.queryExecution().optimizedPlan()
    assert "3600" not in plan.toString()


def test_vectors_are_sent_to_few_blocks(spark, monkeypatch):
    """Few blocks, in tiles, give the pairs and groups that all pairs do."""
    monkeypatch.setattr(linking, "_BLOCKS", 3)
    r = np.random.default_rng(3)
    v = r.normal(size=(200, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, i % 3, v[i].tolist()) for i in range(200)], "id long, label long, v array<double>")
    s = 0.35 * (v @ v.T) + 0.65 * (np.arange(200)[:, None] % 3 == np.arange(200)[None, :] % 3)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if s[i, j] >= 0.95}
    pairs = linking.similar_pairs(d, 0.95, block=9).collect()
    assert {(x.a, x.b) for x in pairs} == want and len(pairs) == len(want)
    low = {i: i for i in range(200)}
    for _ in range(200):
        for i, j in want:
            low[i] = low[j] = min(low[i], low[j])
    near = {n for p in want for n in p}
    assert set(map(tuple, linking.similar_groups(d, 0.95, block=9).select("node", "label").collect())) == {(n, low[n]) for n in near}
