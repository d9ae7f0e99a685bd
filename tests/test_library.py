"""Sources and sinks of a library of meetings."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.sources import library as L


def test_library_round_trip(spark, tmp_path):
    lib = tmp_path / "lib"
    for mid, fields in (("aaa11111", {"id": "aaa11111", "title": "One"}), ("bbb22222", None)):
        d = lib / f"a-title-{mid}"
        d.mkdir(parents=True)
        (d / "meeting.json").write_text(json.dumps(fields) if fields else "{broken")
        segs = [{"start": 0.0, "end": 2.0, "window": 0, "local_speaker": "S01", "text": "hi", "global": g} for g in ("G00", "G-1")]
        (d / "transcript.json").write_text(json.dumps({"audio": "x", "segments": segs}))
    m = L.read_meetings(spark, str(lib)).collect()
    assert [(r.meeting_id, r.fields.get("title")) for r in m] == [("aaa11111", "One"), ("bbb22222", None)]
    s = L.read_segments(spark, str(lib / "*" / "transcript.json"))
    assert sorted((r.meeting_id, r.seg_idx, r.gid) for r in s.collect()) == [("aaa11111", 0, "G00"), ("aaa11111", 1, None), ("bbb22222", 0, "G00"), ("bbb22222", 1, None)]
    L.write_segments(s, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    L.write_listing(L.read_meetings(spark, str(lib)), str(tmp_path / "tsv"))
    assert spark.read.csv(str(tmp_path / "tsv"), sep="\t").count() == 2


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"a.mp3": "x, y", "b.wav": {"glossary": "z", "roster": ["Ann"]}}, indent=1))
    got = {r.key: (r.glossary, r.roster) for r in L.read_manifest(spark, str(tmp_path / "m.json")).collect()}
    assert got == {"a.mp3": ("x, y", None), "a": ("x, y", None), "b.wav": ("z", ["Ann"]), "b": ("z", ["Ann"])}
    (tmp_path / "r.json").write_text(json.dumps({"id1": ["Ann", "Bob"], "id2": []}, indent=2))
    assert sorted(map(tuple, L.read_roster(spark, str(tmp_path / "r.json")).collect())) == [("id1", "Ann"), ("id1", "Bob")]
    (tmp_path / "g.txt").write_text("one\n\n# note\n two \n")
    assert L.read_glossary(spark, str(tmp_path / "g.txt")) == "one, two "  # lines as they are, in their order
    assert L.read_glossary(spark, str(tmp_path / "g.txt"), comments=True) == "one, # note, two"
    (tmp_path / "long.txt").write_text("\n".join(f"t{i}" for i in range(500)))
    assert L.read_glossary(spark, str(tmp_path / "long.txt")) == ",".join(f"t{i}" for i in range(500))
    assert L.glossary_of(spark, str(tmp_path / "g.txt")) == "one, two " and L.glossary_of(spark, "a, b") == "a, b" and L.glossary_of(spark, "") == ""
    for missing in ("words.txt", "my/words", "x.list"):
        with pytest.raises(FileNotFoundError):
            L.glossary_of(spark, missing)
    (tmp_path / "x.MP3").write_bytes(b"1")
    assert [r.path.rsplit("/", 1)[1] for r in L.recordings(spark, str(tmp_path)).collect()] == ["x.MP3"]


def test_ids_and_maps(spark):
    titles = spark.createDataFrame([("Weekly Sync",), ("Other",)], "title string")
    none = spark.createDataFrame([], "meeting_id string")
    a = L.new_folders(titles, none).collect()
    assert len({r.meeting_id for r in a}) == 2 and all(len(r.meeting_id) == 8 for r in a)
    again = L.new_folders(titles, spark.createDataFrame([(a[0].meeting_id,)], "meeting_id string"))
    assert a[0].meeting_id not in {r.meeting_id for r in again.collect()} and again.count() == 2
    m = spark.range(1).select(L.merge_fields(F.expr("map('a','1','b','2')"), F.expr("map('b','3','c','4')")).alias("m")).first().m
    assert m == {"a": "1", "b": "3", "c": "4"}
    names = L.name_map(spark.createDataFrame([(1, "G01", "Bob"), (1, "G00", "Ann"), (1, "G02", None)], "meeting_id long, gid string, person string")).first().names
    assert names == {"G00": "Ann", "G01": "Bob"}
    c = L.read_centroids(spark.createDataFrame([("G00", [3.0, 4.0]), ("G-1", [1.0, 0.0]), ("G01", [0.0, 0.0])], "cluster string, v array<double>")).collect()
    assert [(r.cluster, r.v) for r in c] == [("G00", [0.6, 0.8])]


def test_status(spark):
    rows = [("a", None, 1, 1.0, True, True), ("b", 5.0, 0, 0.0, True, True), ("c", 5.0, 2, 0.5, True, True), ("d", 5.0, 2, 0.99, True, True), ("e", 5.0, 2, 0.5, False, True), ("f", 5.0, 2, 0.99, True, False), ("g", 5.0, None, None, None, None), ("h", 5.0, 1, None, None, None)]
    told = L.status(spark.createDataFrame(rows, "path string, duration_s double, n_segments int, coverage double, embedded boolean, rendered boolean"))
    assert {r.path: (r.status, r.short) for r in told.collect()} == {"a": ("unreadable", False), "b": ("empty", False), "c": ("short", True), "d": ("ok", False), "e": ("failed", True), "f": ("broken", False), "g": ("empty", False), "h": ("ok", False)}
    assert {r.status: (r.n, r["short"]) for r in L.status_counts(told).collect()} == {"unreadable": (1, 0), "empty": (2, 0), "short": (1, 1), "ok": (2, 0), "failed": (1, 1), "broken": (1, 0)}


def test_legacy_vector_files(spark, tmp_path):
    for mid, n in (("aaa", 3), ("bbb", 0)):
        d = tmp_path / f"x-{mid}"
        d.mkdir()
        np.savez(d / "embeddings.npz", emb=np.arange(n * 4, dtype=np.float32).reshape(n, 4), seg_idx=np.arange(n) * 2, meta="[]")
        np.savez(d / "clusters.npz", centroid=np.array([[3, 4], [0, 0], [1, 0]], np.float32), cluster=np.array(["G00", "G01", "G-1"]), secs=np.array([9, 1, 1], np.float32), meeting=np.array(mid))
    got = L.read_vectors(spark, str(tmp_path / "*" / "embeddings.npz"))
    assert sorted((r.meeting_id, r.seg_idx, r.v) for r in got.collect()) == [("aaa", 2 * i, [4.0 * i + j for j in range(4)]) for i in range(3)]
    clusters = L.read_cluster_files(spark, str(tmp_path / "*" / "clusters.npz")).collect()
    assert sorted((r.meeting_id, r.cluster, [round(x, 6) for x in r.v], r.seconds) for r in clusters) == [(m, "G00", [0.6, 0.8], 9.0) for m in ("aaa", "bbb")]
    np.savez(tmp_path / "x-aaa" / "embeddings.npz", emb=np.array([{}], object), seg_idx=np.zeros(1))
    with pytest.raises(Exception, match="allow_pickle"):
        L.read_vectors(spark, str(tmp_path / "x-aaa" / "embeddings.npz")).collect()


def test_update_meeting(spark, tmp_path):
    folder = str(tmp_path / "lib" / "one-aaa")
    (tmp_path / "lib" / "one-aaa").mkdir(parents=True)
    assert L.update_meeting(spark, folder, id="aaa", title="Köln", n_segments=3) == {"id": "aaa", "title": "Köln", "n_segments": 3}
    assert L.update_meeting(spark, folder, n_segments=4, coverage=0.5) == {"id": "aaa", "title": "Köln", "n_segments": 4, "coverage": 0.5}
    assert json.loads((tmp_path / "lib" / "one-aaa" / "meeting.json").read_text())["n_segments"] == 4
    assert L.read_meetings(spark, str(tmp_path / "lib")).first().fields["title"] == "Köln"
    for broken in ("{", "[1]"):
        (tmp_path / "lib" / "one-aaa" / "meeting.json").write_text(broken)
        (tmp_path / "lib" / "one-aaa" / ".meeting.json.crc").unlink(missing_ok=True)
        assert L.update_meeting(spark, folder, x=1) == {"x": 1}


def test_worklist(spark, tmp_path):
    box, other, done = tmp_path / "inbox", tmp_path / "other", tmp_path / "done"
    box.mkdir()
    other.mkdir()
    doc = json.dumps({"audio": "x", "duration_s": 1.0, "segments": []})
    (box / "a.json").write_text(doc)
    (other / "b.json").write_text(doc)
    assert L.stage(spark, [str(box / "a.json"), str(other / "b.json")], str(box)) == ["a.json", "b.json"]
    assert (other / "b.json").exists() and (box / "b.json").read_text() == doc
    with pytest.raises(ValueError):
        L.stage(spark, [str(box / "a.json"), str(other / "a.json")], str(box))

    def drain(archive, name):
        q = L.inbox(spark, str(box), archive).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / name)).count()

    assert drain(None, "kept") == 2 and drain(None, "kept") == 2  # the checkpoint knows them
    assert (box / "a.json").exists() and (box / "b.json").exists()
    assert drain(str(done), "moved") == 2
    (box / "c.json").write_text(doc)
    assert drain(str(done), "moved") == 3  # the next run moves what the last one has read
