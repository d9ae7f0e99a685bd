"""The identity store on disk: fixed schemas, migration of older ones, whole versions only.

A version is a small file in ``_versions`` that names the folder of each table
and the schema they have. It is written last and in one step, so a reader sees
a whole version or the one before, an interrupted save leaves nothing but
unnamed folders, and of two writers that began with one version the second is
refused. Tables that didn't change are named again, not written again.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestrata.operators.store import Store
from lodestrata.runtime import names_in, read_small, remove, write_new

#: Tables by schema number, the last one current.
SCHEMAS: dict[int, dict[str, str]] = {
    1: {
        "speakers": "id long, name string, created_at double",
        "groups": "group_id long, speaker_id long, linked_at double",
        "clusters": "id long, meeting_id string, cluster string, v array<double>, digest string, seconds double, group_id long, created_at double",
        "exemplars": "speaker_id long, era string, v array<double>, seconds double, created_at double",
    }
}
SCHEMAS[2] = SCHEMAS[1] | {"exemplars": "speaker_id long, condition string, v array<double>, seconds double, created_at double"}
SCHEMAS[3] = {t: f"{ddl}, embed_model string" if t != "speakers" else ddl for t, ddl in SCHEMAS[2].items()}
CURRENT = max(SCHEMAS)
#: Columns that a store must bring; the others are null where they lack.
REQUIRED = {"speakers": ("id", "name"), "groups": ("group_id", "speaker_id"), "clusters": ("meeting_id", "cluster", "seconds", "group_id"), "exemplars": ("speaker_id", "condition", "v", "seconds")}

Tables = dict[str, DataFrame]


def _condition(t: Tables) -> Tables:
    """Exemplars once had an era for their condition."""
    return t | {"exemplars": t["exemplars"].withColumnRenamed("era", "condition")}


def _model(t: Tables) -> Tables:
    """All vectors were of one model, which had no name."""
    return {n: d if n == "speakers" else d.withColumn("embed_model", F.lit("").cast("string")) for n, d in t.items()}


#: What leads from a schema to the next.
MIGRATIONS: dict[int, Callable[[Tables], Tables]] = {1: _condition, 2: _model}


class Conflict(RuntimeError):
    """Another writer has published a version since the one this change began with."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    schema: int = CURRENT
    tables: dict[str, str] = field(default_factory=dict)  # folders, below the store's
    notes: dict = field(default_factory=dict)


def conform(d: DataFrame, table: str, schema: int = CURRENT) -> DataFrame:
    """The schema's columns in its order and types; what may lack is null, other columns go. A required column that lacks is an error."""
    lacking = [c for c in REQUIRED[table] if c not in d.columns and schema == CURRENT]
    if lacking:
        raise ValueError(f"{table} lacks {', '.join(lacking)}")
    kinds = StructType.fromDDL(SCHEMAS[schema][table])
    return d.select(*((F.col(f.name) if f.name in d.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds))


def versions(spark: SparkSession, path: str) -> list[int]:
    return [int(n.removesuffix(".json")) for n, _ in names_in(spark, f"{path}/_versions") if n.endswith(".json") and n[0] != "."]


def _version(spark: SparkSession, path: str, number: int) -> Version:
    return Version(**json.loads(read_small(spark, f"{path}/_versions/{number:012d}.json")))


def _legacy(spark: SparkSession, path: str) -> Version | None:
    """A store of plain ``v1``, ``v2``, ... folders: the last in which all tables are complete. Its schema is told by its columns."""
    for n in sorted((int(x[1:]) for x, _ in names_in(spark, path) if x[0] == "v" and x[1:].isdigit()), reverse=True):
        if all("_SUCCESS" in dict(names_in(spark, f"{path}/v{n}/{t}")) for t in Store.TABLES):
            columns = spark.read.parquet(f"{path}/v{n}/exemplars").columns
            return Version(0, 1 if "era" in columns else 2 if "embed_model" not in columns else 3, {t: f"v{n}/{t}" for t in Store.TABLES})
    return None


def open_store(spark: SparkSession, path: str, number: int | None = None) -> tuple[Store, Version]:
    """The store at a version (the last by default) in the current schema, and that version. A path without one is an error."""
    found = versions(spark, path)
    at = (_version(spark, path, number if number is not None else found[-1])) if found else _legacy(spark, path)
    if at is None:
        raise FileNotFoundError(f"no store at {path}")
    if at.schema > CURRENT:
        raise ValueError(f"the store has schema {at.schema}, this library knows {CURRENT}")
    tables = {t: conform(spark.read.parquet(f"{path}/{folder}"), t, at.schema) for t, folder in at.tables.items()}
    for n in range(at.schema, CURRENT):
        tables = MIGRATIONS[n](tables)
    return Store(*(conform(tables[t], t) for t in Store.TABLES)), at


def commit(store: Store, path: str, base: Version | None = None, changed: tuple[str, ...] = Store.TABLES, **notes) -> Version:
    """Writes the next version after ``base`` (None: the first) and gives it. ``notes`` replace the base's of the same name.

    Only the tables in ``changed`` are written, unless the base has an older
    schema. Raises ``Conflict`` if there is a version after ``base`` already.
    """
    spark = store.speakers.sparkSession
    base = base or Version()
    data = f"data/{uuid.uuid4().hex}"
    if base.schema != CURRENT or not base.tables or any(not f.startswith("data/") for f in base.tables.values()):
        changed = Store.TABLES
    for t in changed:
        conform(getattr(store, t), t).write.parquet(f"{path}/{data}/{t}")
    new = Version(base.number + 1, CURRENT, base.tables | {t: f"{data}/{t}" for t in changed}, base.notes | notes)
    if not write_new(spark, f"{path}/_versions/{new.number:012d}.json", json.dumps(new.__dict__)):
        remove(spark, f"{path}/{data}")
        raise Conflict(f"version {new.number} of {path} exists")
    return new


def transact(spark: SparkSession, path: str, change: Callable[[Store], Store], changed: tuple[str, ...] = Store.TABLES, tries: int = 5) -> Version:
    """Commits ``change`` of the last version; made anew if another writer was first."""
    for _ in range(tries - 1):
        store, at = open_store(spark, path)
        try:
            return commit(change(store), path, at, changed)
        except Conflict:
            continue
    store, at = open_store(spark, path)
    return commit(change(store), path, at, changed)


def sweep(spark: SparkSession, path: str, keep: int = 10, idle_s: float = 86_400.0) -> list[str]:
    """Deletes all but the last ``keep`` versions, and folders that no version names and that are older than ``idle_s``, a day by default, as a save may still be running. Gives the folders."""
    found = versions(spark, path)
    for n in found[:-keep]:
        remove(spark, f"{path}/_versions/{n:012d}.json")
    named = {f.split("/")[1] for n in found[-keep:] for f in _version(spark, path, n).tables.values()}
    gone = [n for n, at in names_in(spark, f"{path}/data") if n not in named and at < time.time() - idle_s]
    for n in gone:
        remove(spark, f"{path}/data/{n}")
    return gone
