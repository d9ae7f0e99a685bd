"""Voices of a stream named and learned from, batch by batch, against the store on disk."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import matching
from lodestrata.operators.store import Store, pool_exemplars
from lodestrata.params import DEFAULTS
from lodestrata.runtime import settled
from lodestrata.sources import versions


def enrol_batch(store: Store, atoms: DataFrame, condition: str = "stream", p=DEFAULTS) -> tuple[DataFrame, Store]:
    """(meeting_id, vec_id, person, sim), and the store that has learned from them.

    atoms: meeting_id, win, vec_id, label, sec, v. They are named one to one
    in their windows from the store's exemplars as they were before the batch;
    then what a person said in the batch, if ``min_enroll_sec`` seconds or
    more, is pooled into the person's exemplar of ``condition``, once.
    """
    bank = store.exemplars.select(F.col("speaker_id").alias("person"), "v")
    named = settled(matching.one_to_one(matching.scores(atoms.select("meeting_id", "win", "vec_id", "label", "sec", "v"), bank), p.accept))
    own = atoms.join(named.select("meeting_id", "vec_id", F.col("person").cast("long").alias("speaker_id")), ["meeting_id", "vec_id"])
    heard = own.groupBy("speaker_id").agg(F.sum("sec").alias("seconds")).filter(F.col("seconds") >= p.min_enroll_sec)
    new = matching.pool(own, "speaker_id", weight="sec").join(heard, "speaker_id").select("speaker_id", F.lit(condition).alias("condition"), "v", "seconds")
    kept = ["speaker_id", "condition", "v", "seconds"]
    touched = new.select("speaker_id", "condition")
    pooled = pool_exemplars(store.exemplars.select(*kept).join(touched, ["speaker_id", "condition"], "left_semi"), new)
    others = store.exemplars.join(touched, ["speaker_id", "condition"], "left_anti")
    return named, replace(store, exemplars=settled(others.unionByName(pooled, allowMissingColumns=True)))


def enrol_stream(stream: DataFrame, path: str, sink: str, checkpoint: str, name: str, condition: str = "stream", p=DEFAULTS, tries: int = 5):
    """Names each arriving atom, writes it to ``sink`` by batch, and commits what was learned to the store at ``path``; ends with what is there.

    A version notes the last batch of the stream ``name`` that it holds. A
    batch that runs again before its commit finds the store as it was and
    replaces its own rows; one that runs again after it changes nothing. If
    another writer commits meanwhile, the batch is made anew from its version.
    """

    def step(batch: DataFrame, n: int) -> None:
        rows = settled(batch)
        for again in range(tries):
            store, at = versions.open_store(batch.sparkSession, path)
            done = at.notes.get("batches", {})
            if done.get(name, -1) >= n:
                return
            named, new = enrol_batch(store, rows, condition, p)
            named.write.mode("overwrite").parquet(f"{sink}/batch={n}")
            try:
                versions.commit(new, path, at, changed=("exemplars",), batches=done | {name: n})
                return
            except versions.Conflict:
                if again == tries - 1:
                    raise

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
