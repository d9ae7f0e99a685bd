"""Names given, suggested and written back."""

from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import naming as N
from lodestrata.operators import recovery, reports
from lodestrata.operators import store as S
from lodestrata.sources import tables as T

DATA = "/root/testdata/sf0.001"


def unit(*x):
    return [float(y) for y in np.array(x, float) / np.linalg.norm(x)]


@pytest.fixture
def small(spark):
    clusters = [(1, 1, "G00", 60.0, 10, unit(1, 0, 0)), (2, 2, "G00", 30.0, 10, unit(1, 0.1, 0)), (3, 1, "G01", 90.0, 11, unit(0, 1, 0)), (4, 3, "G00", 40.0, 13, unit(0, 0.9, 0.1))]
    return S.Store(
        spark.createDataFrame([(7, "Alice Berg"), (2, "Bob")], "id long, name string"),
        spark.createDataFrame([(10, None), (11, 7), (12, None), (13, None)], "group_id long, speaker_id long"),
        spark.createDataFrame(clusters, "id long, meeting_id long, cluster string, seconds double, group_id long, v array<double>"),
        spark.createDataFrame([(7, "room", unit(0, 1, 0), 5.0), (7, "auto-1", unit(1, 1, 1), 5.0), (2, "room", unit(0, 0, 1), 9.0)], "speaker_id long, condition string, v array<double>, seconds double"),
    )


def exemplars(s, who):
    return {r.condition: (r.seconds, [round(x, 6) for x in r.v]) for r in s.exemplars.filter(F.col("speaker_id") == who).collect()}


def owner(s, group):
    return s.groups.filter(F.col("group_id") == group).first().speaker_id


def test_name_a_new_person(small):
    got = N.name_group(small, 10, "Carol", condition="phone")
    assert {r.name: r.id for r in got.speakers.collect()} == {"Alice Berg": 7, "Bob": 2, "Carol": 8} and owner(got, 10) == 8
    v = 60 * np.array(unit(1, 0, 0)) + 30 * np.array(unit(1, 0.1, 0))
    assert exemplars(got, 8) == {"phone": (90.0, [round(x, 6) for x in v / np.linalg.norm(v)])}
    assert exemplars(got, 7) == exemplars(small, 7) and exemplars(got, 2) == exemplars(small, 2)
    again = N.name_group(got, 13, "Carol", condition="phone")  # the same circumstance: pooled
    assert owner(again, 13) == 8 and exemplars(again, 8)["phone"][0] == 130.0 and again.speakers.count() == 3
    more = N.name_group(got, 13, "Carol", condition="hall")
    assert set(exemplars(more, 8)) == {"phone", "hall"}


def test_names_that_are_near(small):
    with pytest.raises(ValueError, match="close to Alice Berg"):
        N.name_group(small, 10, "Alice Burg")
    assert owner(N.name_group(small, 10, "Alice Burg", near_ok=True, condition="x", new_id=50), 10) == 50
    assert owner(N.name_group(small, 10, "Bob", condition="x"), 10) == 2


def test_attach_by_id_draws_the_profiles_anew(small):
    got = N.name_group(small, 13, "Alice Burg", speaker_id=7)  # the id decides
    assert owner(got, 13) == 7 and got.speakers.count() == 2
    mine = exemplars(got, 7)
    assert mine["room"] == exemplars(small, 7)["room"] and mine["auto-1"][0] == 130.0  # of groups 11 and 13
    assert exemplars(got, 2) == exemplars(small, 2)


@pytest.mark.parametrize(("group", "how", "why"), [(99, {"name": "X"}, "no group"), (12, {"name": "Someone"}, "no members"), (10, {"speaker_id": 5}, "no speaker"), (10, {}, "a name"), (10, {"name": "Quentin", "new_id": 2}, "exists")])
def test_refused_names(small, group, how, why):
    with pytest.raises(ValueError, match=why):
        N.name_group(small, group, **how)


def test_suggest_against_plain_python(spark):
    rows = [(r.meeting_id, r.vec_id, r.win, r.local_label, r.label, r.sec, r.v) for r in T.atoms(spark, DATA).filter("meeting_id < 4").collect()]
    extended = [(*r[:6], [0.65**0.5 * (r[4] == k) for k in range(10)] + [0.35**0.5 * x for x in r[6]]) for r in rows]
    schema = "meeting_id long, vec_id long, win long, local_label string, label int, sec double, v array<double>"
    voices = spark.createDataFrame(extended, schema)
    bank = [(r.person, [0.65**0.5 * (r.person == k) for k in range(10)] + [0.35**0.5 * x for x in r.v]) for r in T.bank(spark, DATA, 2).filter("person < 4").collect()]
    found = recovery.label_meetings(T.atoms(spark, DATA).filter("meeting_id < 4"), T.bank(spark, DATA, 2).filter("person < 4"))
    got = N.suggest_voices(voices.join(found, ["meeting_id", "vec_id"]).withColumn("start", F.col("vec_id")), spark.createDataFrame(bank, "person int, v array<double>"))
    open_ = defaultdict(list)
    who = {(r.meeting_id, r.vec_id): r.person for r in found.collect()}
    for r in extended:
        if not (who[r[0], r[1]] or "").startswith("K"):
            open_[r[0], who[r[0], r[1]] or "UNKNOWN"].append(r)
    want = {}
    for key, rs in open_.items():
        v = sum(r[5] * np.array(r[6]) for r in rs)
        v /= np.linalg.norm(v)
        best = sorted(((-max(float(v @ np.array(b)) for q, b in bank if q == p), p) for p in {p for p, _ in bank}))[:4]
        want[key] = (sum(r[5] for r in rs), [p for _, p in best], [-s for s, _ in best], best[1][0] - best[0][0])
    have = defaultdict(list)
    for r in sorted(got.collect(), key=lambda r: r["rank"]):
        have[r.meeting_id, r.tag].append(r)
    assert set(have) == set(want) and len(want) > 4
    for key, rs in have.items():
        seconds, people, sims, margin = want[key]
        assert (rs[0].seconds, [r.person for r in rs]) == (seconds, people)
        assert [r.sim for r in rs] == pytest.approx(sims) and {round(r.margin, 9) for r in rs} == {round(margin, 9)}
        assert [r.over for r in rs] == [s >= 0.62 for s in sims]


def test_suggest_names_the_meetings_first(spark):
    a = T.atoms(spark, DATA).filter("meeting_id < 3")
    got = N.suggest(a, T.bank(spark, DATA).filter("person < 3"), top=2)
    known = recovery.label_meetings(a, T.bank(spark, DATA).filter("person < 3"))
    open_ = {(r.meeting_id, r.person or "UNKNOWN") for r in known.collect() if not (r.person or "").startswith("K")}
    assert {(r.meeting_id, r.tag) for r in got.collect()} == open_ and got.filter("rank > 2").isEmpty()
    one = N.suggest(a, T.bank(spark, DATA).filter("person = 1"), top=2)
    assert one.filter("rank > 1 OR margin IS NOT NULL").isEmpty() and not one.isEmpty()
    with pytest.raises(ValueError, match="nobody"):
        N.suggest(a, T.bank(spark, DATA).filter("false"))


def test_rosters_limit_the_bank(spark):
    a, bank = T.atoms(spark, DATA).filter("meeting_id < 3"), T.bank(spark, DATA, 2)
    rosters = spark.createDataFrame([(0, [1, 2]), (1, [])], "meeting_id long, people array<long>")
    got = recovery.label_meetings(a, bank, rosters=rosters)
    people = defaultdict(set)
    for r in got.filter("person LIKE 'K%'").collect():
        people[r.meeting_id].add(int(r.person[1:]))
    assert people[0] <= {1, 2} and people[0] and len(people[1]) > 2 and len(people[2]) > 2
    alone = recovery.label_meetings(a.filter("meeting_id = 0"), bank.filter("person IN (1, 2)"))
    assert sorted(map(tuple, got.filter("meeting_id = 0").collect()), key=str) == sorted(map(tuple, alone.collect()), key=str)


def test_backfill(spark):
    one, two = unit(1, 0), unit(0, 1)
    atoms = spark.createDataFrame([(1, 0, 0, "S01", 0, 30.0, one, 1), (1, 1, 0, "S02", 1, 30.0, two, 1), (1, 2, 1, "S01", 0, 30.0, one, 1)], "meeting_id long, vec_id long, win long, local_label string, label int, sec double, v array<double>, n_segments long")
    rows = [(1, 0, 0, "S01", "G05", None, 0.0, "hello"), (1, 1, 0, "S02", "G06", "Bob", 1.0, "yes"), (1, 2, 1, "S01", "G05", None, 2.0, "so"), (2, 0, 0, "S01", "G00", None, 0.0, "on file"), (2, 1, 0, "S02", "G01", "Old", 1.0, "gone")]
    segments = spark.createDataFrame(rows, "meeting_id long, seg_idx long, win long, local_label string, gid string, speaker_name string, start_s double, text string").withColumn("end_s", F.col("start_s") + 1)
    store = S.Store(
        spark.createDataFrame([(0, "Ann"), (9, "Cy")], "id long, name string"),
        spark.createDataFrame([(20, 0), (21, 9), (22, None)], "group_id long, speaker_id long"),
        spark.createDataFrame([(1, "G05", 60.0, "old", 20), (2, "G00", 5.0, "x", 21), (2, "G01", 5.0, "y", 22)], "meeting_id long, cluster string, seconds double, digest string, group_id long"),
        spark.createDataFrame([(0, "room", one, 9.0)], "speaker_id long, condition string, v array<double>, seconds double"),
    )
    bank = spark.createDataFrame([(0, one)], "person int, v array<double>")
    changes, after, new = N.backfill(store, segments, atoms, bank)
    assert after.columns == segments.columns
    assert {(r.meeting_id, r.seg_idx): (r.gid, r.speaker_name) for r in after.collect()} == {(1, 0): ("G00", "Ann"), (1, 1): ("G01", None), (1, 2): ("G00", "Ann"), (2, 0): ("G00", "Cy"), (2, 1): ("G01", None)}
    assert sorted((r.meeting_id, r.gid, r.before, r.after, r.change) for r in changes.collect()) == [(1, "G00", None, "Ann", "gained"), (1, "G06", "Bob", None, "lost"), (2, "G00", None, "Cy", "gained"), (2, "G01", "Old", None, "lost")]
    clusters = {(r.meeting_id, r.cluster): r.group_id for r in new.clusters.collect()}
    assert clusters == {(1, "G00"): 20, (1, "G01"): None, (2, "G00"): 21, (2, "G01"): 22}  # 1's voice is Ann's group again
    assert {(r.meeting_id, r.cluster) for r in store.clusters.collect()} == {(1, "G05"), (2, "G00"), (2, "G01")}  # the store given is as it was
    _, by_groups, same = N.backfill(store, segments, None, None)
    assert {(r.meeting_id, r.gid): r.speaker_name for r in by_groups.collect()} == {(1, "G05"): "Ann", (1, "G06"): None, (2, "G00"): "Cy", (2, "G01"): None} and same is store
    meetings = spark.createDataFrame([(1, "Board", 90.0), (2, "Two", 3600.0)], "meeting_id long, title string, duration double")
    names = after.filter("speaker_name IS NOT NULL").select("meeting_id", "gid", F.col("speaker_name").alias("name")).distinct()
    text = {r.meeting_id: r.text for r in reports.render_transcripts(after, meetings, names).collect()}
    assert text[1] == "Board\n1.5 min · 3 turns · 2 speakers, 1 named\n" + "=" * 66 + "\n\n[0:00:00] Ann\n  hello\n\n[0:00:01] Speaker 2\n  yes\n\n[0:00:02] Ann\n  so\n"
    with pytest.raises(ValueError, match="no named groups"):
        N.backfill(replace(store, groups=store.groups.filter("speaker_id IS NULL")), segments, None, None)


def test_shown_speakers(spark):
    rows = [(1, 0, 0.0, 5.0, "G01"), (1, 1, 5.0, 10.0, "G00"), (1, 2, 10.0, 99.0, None), (1, 3, 99.0, 100.0, "G-1"), (1, 4, 100.0, 110.0, "G02")]
    d = spark.createDataFrame(rows, "meeting_id int, seg_idx int, start_s double, end_s double, gid string")
    names = spark.createDataFrame([(1, "G02", "Ann")], "meeting_id int, gid string, name string")
    assert {r.gid: r.shown for r in reports.shown_speakers(d, names).collect()} == {"G02": "Ann", "G01": "Speaker 2", "G00": "Speaker 3", None: "UNKNOWN", "G-1": "UNKNOWN"}
