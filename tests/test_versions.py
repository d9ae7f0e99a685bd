"""The store on disk, outputs with acks, and enrolment from a stream."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import store as S
from lodestrata.runtime import names_in
from lodestrata.sources import acks as A
from lodestrata.sources import versions as V
from lodestrata.streaming import enrolment as E


def store(spark, names=("Ann", "Bob")):
    unit = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    return S.Store(
        spark.createDataFrame([(k, n) for k, n in enumerate(names)], "id long, name string"),
        spark.createDataFrame([(10, 0), (11, None)], "group_id long, speaker_id long"),
        spark.createDataFrame([(1, "G00", 60.0, 10)], "meeting_id long, cluster string, seconds double, group_id long"),
        spark.createDataFrame([(k, "room", unit[k], 20.0) for k in range(len(names))], "speaker_id long, condition string, v array<double>, seconds double"),
    )


def rename(k, name):
    return lambda s: S.rename_speaker(s, k, name)


def names(s):
    return {r.id: r.name for r in s.speakers.collect()}


def test_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        V.open_store(spark, path)
    first = V.commit(store(spark), path)
    second = V.transact(spark, path, rename(0, "Eve"), changed=("speakers",))
    s, at = V.open_store(spark, path)
    assert (first.number, second.number, at) == (1, 2, second) and names(s) == {0: "Eve", 1: "Bob"}
    assert names(V.open_store(spark, path, 1)[0]) == {0: "Ann", 1: "Bob"}
    assert second.tables["clusters"] == first.tables["clusters"] != second.tables["speakers"]
    assert [f.name for f in s.exemplars.schema] == ["speaker_id", "condition", "v", "seconds", "created_at", "embed_model"]
    assert all(r.n == 0 for r in S.integrity(s).collect())
    with pytest.raises(ValueError, match="lacks name"):
        V.commit(S.replace(store(spark), speakers=store(spark).speakers.drop("name")), path, second)


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "s")
    base = V.commit(store(spark), path)
    V.commit(rename(0, "Eve")(V.open_store(spark, path)[0]), path, base)
    with pytest.raises(V.Conflict):
        V.commit(rename(1, "Max")(V.open_store(spark, path, 1)[0]), path, base)
    assert names(V.open_store(spark, path)[0]) == {0: "Eve", 1: "Bob"}
    todo = [threading.Thread(target=V.transact, args=(spark, path, rename(1, n))) for n in ("Max", "Mia", "Moe")]
    for t in todo:
        t.start()
    for t in todo:
        t.join()
    assert V.versions(spark, path) == [1, 2, 3, 4, 5] and names(V.open_store(spark, path)[0])[1] in ("Max", "Mia", "Moe")


def test_an_interrupted_save_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    base = V.commit(store(spark), path)

    def fail(*_):
        raise OSError("the writer died")

    with monkeypatch.context() as m:
        m.setattr(V, "write_new", fail)
        with pytest.raises(OSError, match="died"):
            V.commit(rename(0, "Eve")(store(spark)), path, base)
    assert names(V.open_store(spark, path)[0])[0] == "Ann" and len(names_in(spark, f"{path}/data")) == 2
    assert V.sweep(spark, path) == [] and len(V.sweep(spark, path, idle_s=-5)) == 1
    V.transact(spark, path, rename(0, "Eve"), changed=("speakers",))
    assert V.sweep(spark, path, keep=1, idle_s=-5) == [] and V.versions(spark, path) == [2]  # the first version's tables are named still
    assert names(V.open_store(spark, path)[0]) == {0: "Eve", 1: "Bob"}


@pytest.mark.parametrize("schema", [1, 2])
def test_older_stores(spark, tmp_path, schema):
    path, s = str(tmp_path / "s"), store(spark)
    old = S.replace(s, exemplars=s.exemplars.withColumnRenamed("condition", "era") if schema == 1 else s.exemplars)
    old.save(path, 3)
    (tmp_path / "s" / "v4" / "speakers").mkdir(parents=True)  # never finished
    got, at = V.open_store(spark, path)
    assert at.schema == schema and {(r.condition, r.embed_model) for r in got.exemplars.collect()} == {("room", "")}
    new = V.transact(spark, path, rename(0, "Eve"), changed=("speakers",))
    assert (new.number, new.schema) == (1, V.CURRENT) and all(f.startswith("data/") for f in new.tables.values())
    assert names(V.open_store(spark, path)[0]) == {0: "Eve", 1: "Bob"}


def test_a_newer_store_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    V.commit(store(spark), path)
    monkeypatch.setattr(V, "CURRENT", V.CURRENT - 1)
    with pytest.raises(ValueError, match="schema"):
        V.open_store(spark, path)


# --- acks ---


def test_acks(spark, tmp_path):
    folder, ledger = str(tmp_path / "out"), str(tmp_path / "acks")
    jobs = spark.createDataFrame([("a", 1), ("b c/d", 2), ("e", 3)], "output string, x int")
    make = lambda d: d.select("output", F.when(F.col("x") < 3, F.concat(F.lit("made "), F.col("x").cast("string"))).alias("value"))
    assert A.run_pending(jobs, make, folder, ledger) == 3
    assert {r.output: r.ok for r in A.drain(jobs, ledger).collect()} == {"a": True, "b c/d": True, "e": False}
    assert {(r.output, r.value) for r in spark.read.text(folder).collect()} == {("a", "made 1"), ("b c/d", "made 2")}
    again = lambda d: d.select("output", F.lit("again").alias("value"))
    assert A.run_pending(jobs, again, folder, ledger) == 1  # what failed only
    assert A.run_pending(jobs, again, folder, ledger) == 0
    A.reset(jobs.filter("x = 1"), ledger)
    assert {r.output for r in A.drain(jobs, ledger).collect()} == {"b c/d", "e"}
    assert A.run_pending(jobs, again, folder, ledger) == 1
    assert {(r.output, r.value) for r in spark.read.text(folder).collect()} == {("a", "again"), ("b c/d", "made 2"), ("e", "again")}


def test_a_crash_before_the_ack_is_repaired(spark, tmp_path):
    folder, ledger = str(tmp_path / "out"), str(tmp_path / "acks")
    jobs = spark.createDataFrame([("a",), ("b",)], "output string")
    jobs.withColumn("value", F.lit("half")).filter("output = 'a'").write.partitionBy("output").text(folder)  # written, never acknowledged
    jobs.select("output", F.lit("ok").alias("status"), F.lit(1).cast("long").alias("run")).filter("output = 'b'").write.parquet(ledger)  # acknowledged, its file lost
    assert {r.output for r in A.unfinished(jobs, A.ledger(spark, ledger), A.outputs(spark, folder)).collect()} == {"a", "b"}
    assert A.run_pending(jobs, lambda d: d.withColumn("value", F.lit("whole")), folder, ledger) == 2
    assert {(r.output, r.value) for r in spark.read.text(folder).collect()} == {("a", "whole"), ("b", "whole")}


# --- enrolment ---

ATOMS = "meeting_id long, win long, vec_id long, label int, sec double, v array<double>"


def atoms(spark, seed, n):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        v = [r.gauss(0, 0.2) for _ in range(3)]
        v[i % 3] += 1
        size = sum(x * x for x in v) ** 0.5
        rows.append((seed, i // 3, seed * 1000 + i, i % 3, float(r.randrange(2, 30)), [x / size for x in v]))
    return spark.createDataFrame(rows, ATOMS)


def flat(s):
    return {(r.speaker_id, r.condition): (round(r.seconds, 6), [round(x, 9) for x in r.v]) for r in s.exemplars.collect()}


def test_enrolment_from_a_stream(spark, tmp_path, monkeypatch):
    path, sink, box, check = (str(tmp_path / x) for x in ("store", "sink", "box", "check"))
    V.commit(store(spark), path)
    batches = [atoms(spark, k, 12) for k in (1, 2)]
    want = V.conform(store(spark).exemplars, "exemplars")
    want = S.replace(store(spark), exemplars=want)
    rows = []
    for k, b in enumerate(batches):  # one file a batch
        b.coalesce(1).write.mode("append").parquet(box)
        named, want = E.enrol_batch(want, b)
        rows += [(r.vec_id, r.person, k) for r in named.collect()]
        if k == 0:  # the first commit is lost: its batch is made again
            real = V.commit

            def lost(*_, **__):
                raise OSError("the driver died")

            monkeypatch.setattr(V, "commit", lost)
            with pytest.raises(Exception, match="died"):
                E.enrol_stream(spark.readStream.schema(ATOMS).parquet(box), path, sink, check, "live").awaitTermination()
            monkeypatch.setattr(V, "commit", real)
        E.enrol_stream(spark.readStream.schema(ATOMS).parquet(box), path, sink, check, "live").awaitTermination()
    got, at = V.open_store(spark, path)
    assert at.number == 3 and at.notes == {"batches": {"live": 1}}
    assert flat(got) == flat(want) and ("stream" in {c for _, c in flat(got)})
    assert sorted((r.vec_id, r.person, r.batch) for r in spark.read.parquet(sink).collect()) == sorted(rows)
    (tmp_path / "check" / "commits" / "1").unlink()  # Spark forgets that the last batch ended, and runs it again
    (tmp_path / "check" / "commits" / ".1.crc").unlink(missing_ok=True)
    E.enrol_stream(spark.readStream.schema(ATOMS).parquet(box), path, sink, check, "live").awaitTermination()
    again, at = V.open_store(spark, path)
    assert at.number == 3 and flat(again) == flat(want)
    assert sorted((r.vec_id, r.person, r.batch) for r in spark.read.parquet(sink).collect()) == sorted(rows)
