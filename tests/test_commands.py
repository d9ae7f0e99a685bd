"""The commands over a store on disk, one after another, with plain vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata import commands as K
from lodestrata.operators import naming
from lodestrata.operators.store import Store
from lodestrata.sources import acks, versions


def unit(*x):
    return [float(y) for y in np.array(x, float) / np.linalg.norm(x)]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    p = str(tmp_path_factory.mktemp("store") / "s")
    empty = {t: spark.createDataFrame([], ddl) for t, ddl in versions.SCHEMAS[versions.CURRENT].items()}
    versions.commit(Store(*(empty[t] for t in Store.TABLES)), p)
    a, b, c = unit(1, 0, 0), unit(0, 1, 0), unit(0, 0, 1)
    rows = [(m, "G00", v, 100.0 + m) for m, v in ((1, a), (2, unit(1, 0.1, 0)), (3, unit(1, 0, 0.1)))] + [(m, "G01", v, 80.0) for m, v in ((1, b), (2, unit(0.1, 1, 0)))] + [(3, "G01", c, 70.0), (3, "G02", c, 20.0)]
    K.index(spark, p, spark.createDataFrame(rows, "meeting_id long, cluster string, v array<double>, seconds double"))
    return p


def test_one_after_another(spark, path):
    s, at = versions.open_store(spark, path)
    ids = [r.id for r in s.clusters.collect()]
    assert len(set(ids)) == 7 and min(ids) > 0 and at.number == 2
    dry = K.link(spark, path)
    assert versions.open_store(spark, path)[1].number == 2 and dry.count() == 6
    by = {}
    for r in dry.collect():
        by.setdefault(r.grp, set()).add(r.meeting_id)
    assert sorted(map(sorted, by.values())) == [["1", "2"], ["1", "2", "3"], ["3"]]
    K.link(spark, path, apply=True)
    rows = K.groups(spark, path).collect()
    assert [(r.meetings, r.n_clusters, r.name) for r in rows] == [(3, 3, None), (2, 2, None), (1, 1, None)]
    queue = K.review(spark, path, samples=spark.createDataFrame([("1", "G00", "a long sample")], "meeting_id string, cluster string, sample string")).collect()
    assert [(r.group_id, r.sample) for r in queue] == [(rows[0].group_id, "a long sample" if queue[0].sample else None), (rows[1].group_id, None), (rows[2].group_id, None)]
    K.name(spark, path, rows[0].group_id, "Alice Berg")
    with pytest.raises(ValueError, match="close to"):
        K.name(spark, path, rows[1].group_id, "Alice Burg")
    K.name(spark, path, rows[1].group_id, "Bob", condition="room")
    assert [(r.name, r.conditions, r.seconds) for r in K.speakers(spark, path).collect()] == [("Alice Berg", 1, 306.0), ("Bob", 1, 160.0)]
    p = K.profiles_of(spark, path, "Alice Berg", show=2).collect()
    assert [(r.condition, r.n, r.auto, r["rank"], r.meeting_id, r.cluster) for r in p] == [("auto-1", 3, True, 1, "3", "G00"), ("auto-1", 3, True, 2, "2", "G00")] and all(r.fit > 0.99 for r in p)
    assert K.suspects(spark, path, "Alice Berg").isEmpty() and K.suspects(spark, path, "Alice Berg", below=1.1).count() == 3
    K.profile_rename(spark, path, "Alice Berg", "auto-1", "hall")
    with pytest.raises(ValueError):
        K.profile_rename(spark, path, "Nobody", "auto-1", "hall")
    assert K.profiles_of(spark, path, 1).first().condition == "hall"
    # a new decode of meeting 3: its voices keep their groups where the vectors are the same
    K.index(spark, path, spark.createDataFrame([(3, "G00", unit(1, 0, 0.1), 103.0), (3, "G01", unit(0, 1, 0.2), 90.0)], "meeting_id long, cluster string, v array<double>, seconds double"))
    got = {r.cluster: r.group_id for r in versions.open_store(spark, path)[0].clusters.filter("meeting_id = 3").collect()}
    assert got == {"G00": rows[0].group_id, "G01": None}
    found = {(r.meeting_id, r.speaker_id, r.how) for r in K.link(spark, path, apply=True).collect()}
    bob = K.speakers(spark, path).filter("name = 'Bob'").first().id
    assert ("3", bob, "claimed") in found
    assert {r.meetings for r in K.groups(spark, path).collect() if r.name == "Bob"} == {3}
    K.rename(spark, path, bob, "Robert")
    K.forget(spark, path, bob)
    assert [r.name for r in K.speakers(spark, path).collect()] == ["Alice Berg"]
    with pytest.raises(ValueError):
        K.forget(spark, path, bob)


def test_suggest_and_apply(spark, path, tmp_path):
    a, b = unit(1, 0, 0), unit(0, 1, 0)
    atoms = spark.createDataFrame([("9", 0, 0, "S01", 30.0, a, 1), ("9", 1, 0, "S02", 20.0, b, 1), ("9", 2, 1, "S01", 5.0, b, 1)], "meeting_id string, vec_id long, win long, local_label string, sec double, v array<double>, n_segments long")
    got = K.suggest(spark, path, atoms).collect()
    assert [(r.tag[0], r.seconds, r.name, r["rank"]) for r in got] == [("P", 25.0, "Alice Berg", 1)] and len(got[0].bar) <= 1 and not got[0].over
    with pytest.raises(ValueError, match="nobody"):
        K.suggest(spark, path, atoms, roster=["Somebody Else"])
    rows = [("9", i, i // 2, f"S0{i % 2 + 1}", None, None, float(i), i + 1.0, f"text {i}") for i in range(3)]
    segments = spark.createDataFrame(rows, "meeting_id string, seg_idx long, win long, local_label string, gid string, speaker_name string, start_s double, end_s double, text string")
    meetings = spark.createDataFrame([("9", "Nine", 60.0)], "meeting_id string, title string, duration double")
    before = versions.open_store(spark, path)[1].number
    out = str(tmp_path / "out")
    dry = K.apply(spark, path, segments, atoms, meetings, out)
    assert [(r.meeting_id, r.gid, r.after, r.change) for r in dry.collect()] == [("9", "G00", "Alice Berg", "gained")]
    assert versions.open_store(spark, path)[1].number == before and not (tmp_path / "out").exists()
    K.apply(spark, path, segments, atoms, meetings, out, apply=True)
    store, at = versions.open_store(spark, path)
    assert at.number == before + 1 and {r.cluster for r in store.clusters.filter("meeting_id = '9'").collect()} == {"G00", "G01"}
    alice = K.groups(spark, path).filter("name = 'Alice Berg'").first().group_id
    assert {r.cluster: r.group_id for r in store.clusters.filter("meeting_id = '9'").collect()} == {"G00": alice, "G01": None}
    text = "\n".join(r.value for r in spark.read.text(f"{out}/transcripts/output=9", wholetext=True).collect())
    assert text.startswith("Nine\n1.0 min · 3 turns · 2 speakers, 1 named\n" + "=" * 66 + "\n\n[0:00:00] Alice Berg\n  text 0\n\n[0:00:01] Speaker 1\n  text 1\n  text 2\n")
    assert acks.drain(spark.createDataFrame([("9",)], "output string"), f"{out}/acks").first().ok
    assert naming.names_from_groups(store).filter("meeting_id = '9'").first().name == "Alice Berg"
