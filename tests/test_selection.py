"""Lookups and predicates: their edge cases."""

import pytest
from pyspark.errors import PySparkException

from lodestrata.operators import selection


def test_empty_roster_is_everyone(spark):
    bank = spark.createDataFrame([("a", 1), ("b", 2)], "person string, x int")
    none = spark.createDataFrame([], "person string")
    assert selection.in_roster(bank, none, "person").count() == selection.in_roster(bank, None, "person").count() == 2
    assert [r.x for r in selection.in_roster(bank, spark.createDataFrame([("b",), ("b",)], "person string"), "person").collect()] == [2]


def test_labels_must_count_the_segments(spark):
    s = spark.createDataFrame([(1, 0, "S01", 0), (1, 0, "S01", 1), (1, 1, "S01", 2)], "meeting_id int, win int, local_label string, seg_idx int")
    labels = "meeting_id int, win int, local_label string, label string, n_segments int"
    good = selection.labels_to_segments(s, spark.createDataFrame([(1, 0, "S01", "G00", 2)], labels))
    assert sorted((r.seg_idx, r.label) for r in good.collect()) == [(0, "G00"), (1, "G00"), (2, None)]
    with pytest.raises(PySparkException, match="differ in number"):
        selection.labels_to_segments(s, spark.createDataFrame([(1, 0, "S01", "G00", 3)], labels)).collect()


def test_clips_are_refused(spark):
    ok = spark.createDataFrame([("a/clipsy/b.wav",)], "p string")
    assert ok.select(selection.refuse_clips(ok["p"]).alias("p")).first().p == "a/clipsy/b.wav"
    bad = spark.createDataFrame([("a/clips/b.wav",)], "p string")
    with pytest.raises(PySparkException, match="a clip is no recording"):
        bad.select(selection.refuse_clips(bad["p"])).collect()


def test_keys_without_vectors_keep_a_row(spark):
    s = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "meeting_id int, seg_idx int, k string")
    v = spark.createDataFrame([(1, 0, 2.0, [3.0, 4.0])], "meeting_id int, seg_idx int, dur_used double, v array<double>")
    assert sorted(tuple(r) for r in selection.pool_all(s, v, "meeting_id", "k").collect()) == [(1, "a", 2.0, 1, [0.6, 0.8]), (1, "b", 0.0, 0, [0.0, 0.0])]
    assert [(r.n, r.v) for r in selection.pool_all(s, v.filter("false"), "meeting_id", "k").collect()] == [(0, []), (0, [])]


def test_auto_index_and_top(spark):
    names = spark.createDataFrame([("auto-3",), ("auto-12",), ("auto-x",), ("Ann",)], "name string")
    assert selection.next_auto_index(names).first()["next"] == 13
    assert selection.next_auto_index(names.filter("name = 'Ann'")).first()["next"] == 1
    s = spark.createDataFrame([(1, 0, "S01", i, d) for i, d in enumerate([1.0, 3.0, 3.0])], "meeting_id int, win int, local_label string, seg_idx int, dur double")
    assert sorted(r.seg_idx for r in selection.top_segments(s, 1).collect()) == [1]
    assert selection.top_segments(s, 0).count() == 3
