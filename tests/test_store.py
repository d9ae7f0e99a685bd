"""Statements of the identity store, functions over strings, and streams against batches."""

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import store as S
from lodestrata.streaming import windows


@pytest.fixture
def small(spark):
    return S.Store(
        spark.createDataFrame([(1, "Ann"), (2, "Bob")], "id long, name string"),
        spark.createDataFrame([(10, 1), (11, None), (12, 2)], "group_id long, speaker_id long"),
        spark.createDataFrame([(1, "G00", 60.0, 10)], "meeting_id long, cluster string, seconds double, group_id long"),
        spark.createDataFrame([(1, "room", [1.0, 0.0], 5.0), (2, "room", [0.0, 1.0], 5.0)], "speaker_id long, condition string, v array<double>, seconds double"),
    )


def test_rename_checks(small):
    assert {r.name for r in S.rename_speaker(small, 1, "Eve").speakers.collect()} == {"Eve", "Bob"}
    with pytest.raises(ValueError):
        S.rename_speaker(small, 7, "Eve")
    with pytest.raises(ValueError):
        S.rename_speaker(small, 1, "Bob")


def test_forget_cascades(small):
    s = S.forget_speaker(small, 1)
    assert [r.id for r in s.speakers.collect()] == [2]
    assert {r.group_id: r.speaker_id for r in s.groups.collect()} == {10: None, 11: None, 12: 2}
    assert {r.speaker_id for r in s.exemplars.collect()} == {2}
    assert all(r.n == 0 for r in S.integrity(s).collect())


def test_integrity_sees_breaks(small, spark):
    bad = S.Store(small.speakers.filter("id = 2"), small.groups, small.clusters.unionByName(small.clusters), small.exemplars)
    assert {r.problem for r in S.integrity(bad).collect() if r.n} == {"groups.speaker", "exemplars.speaker", "clusters.key"}


def test_snapshots(small, spark, tmp_path):
    small.save(str(tmp_path), 1)
    assert S.Store.load(spark, str(tmp_path), 1).speakers.count() == 2


def test_upsert_leaves_other_meetings(spark):
    schema = "meeting_id long, cluster string, seconds double, digest long"
    old = spark.createDataFrame([(1, "G00", 9.0, 5, 10), (1, "G01", 9.0, 6, 11), (1, "G02", 9.0, 7, 12), (2, "G00", 4.0, 8, 13)], schema + ", group_id long")
    new = spark.createDataFrame([(1, "G00", 8.0, 5), (1, "G01", 8.0, 66), (3, "G00", 1.0, 9)], schema)
    want = {(1, "G00", 8.0, 5, 10), (1, "G01", 8.0, 66, None), (3, "G00", 1.0, 9, None), (2, "G00", 4.0, 8, 13)}
    assert set(map(tuple, S.upsert_clusters(old, new).select("meeting_id", "cluster", "seconds", "digest", "group_id").collect())) == want
    assert set(map(tuple, S.upsert_clusters(old, new.limit(0)).select(old.columns).collect())) == set(map(tuple, old.collect()))


def test_near_names_of_one_beginning(spark):
    """Of 400 names with one beginning only near ones are compared, not all 160,000 pairs."""
    names = spark.range(400).selectExpr("format_string('supplier%09d', id * 7919) AS f")
    near = S.near_candidates(names, names, 1).distinct().collect()
    assert 400 <= len(near) < 4000 and len({r.a_f for r in near if r.a_f == r.b_f}) == 400


@pytest.mark.parametrize("edits", [1, 2])
def test_near_names_finds_all(spark, edits):
    names = ["Anna Berg", "Ana Berg", "AnnaBerg", "Hanna Bergh", "Anna Burg", "Otto", "Oto", "O", "Karl-Heinz", "Karlheinz", "Karl Hein"]
    new = [f"({x})" for x in names] + ["Otto", "李雷", "?!"]
    as_table = lambda x: spark.createDataFrame([(v,) for v in x], "name string")
    got = {(r.a_name, r.b_name) for r in S.near_names(as_table(new), as_table([*names, "王芳"]), edits).collect()}

    def step(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = step(row, i, x, b)
        return row[-1]

    fold = lambda s: "".join(c for c in s.lower() if c.isascii() and c.isalnum())
    assert got == {(a, b) for a in new for b in names if a not in names and fold(a) and dist(fold(a), fold(b)) <= edits}


@pytest.mark.parametrize(
    "title, want",
    [("Weekly Sync", "weekly-sync"), ("", "meeting"), ("!!!", "meeting"), ("Café été", "café-été"), ("a_b c-d e f g", "a-b-c-d-e"), ("x" * 50, "x" * 50), ("short " + "y" * 40, "short")],
)
def test_slug(spark, title, want):
    assert spark.range(1).select(T.slug(F.lit(title)).alias("s")).first().s == want


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.sql("SELECT id % 3 AS user_id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,cast(id * 7 % 240 AS int),0) AS ts, if(id % 2 = 0, 'a', 'b') AS event_type, cast(id AS double) AS value FROM range(200)")
    rows.write.parquet(str(tmp_path / "in"))
    for f in (windows.tumbling, windows.hopping):
        stream = f(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("memory").queryName(f.__name__).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(60)
        key = lambda d: sorted(map(tuple, d.collect()))
        assert key(spark.table(f.__name__)) == key(f(rows))
