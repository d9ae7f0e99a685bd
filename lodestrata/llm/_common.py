"""Plumbing shared by the text operators: Arrow mapping, and tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.runtime import shared_folder, ship

#: Code points that the contracts call white space.
WS = " \t\n\x0b\x0c\r"


def give_back() -> None:
    """Return a finished task's memory to the machine: workers stay alive between tasks, and the C library would keep what they freed."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Recent:
    """Results of ``make`` by key, of about the last ``most`` keys: two generations, the older dropped when the newer is half full. ``new.get`` first, then ``miss``."""

    def __init__(self, make: Callable, most: int):
        self.make, self.half = make, max(1, most // 2)
        self.new: dict = {}
        self.old: dict = {}

    def miss(self, key: str):
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = self.make(key)
            if len(key) <= 48:  # long ones seldom come back
                if len(self.new) >= self.half:
                    self.old, self.new = self.new, {}
                self.new[key] = got
        return got


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, text (null as empty) and the named columns, nothing else of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def settled(d: DataFrame, name: str, value) -> DataFrame:
    """``value`` as a column that later filters and lambdas read and never compute again: the optimizer moves nothing through a generator."""
    return d.select("*", F.explode(F.array(value)).alias(name))


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch | None], Iterable[dict]]], last: bool = False) -> DataFrame:
    """Arrow map. ``make()`` runs once per task and gives a function from a batch to column dicts. With ``last`` the function is called with None behind the last batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            work = make()
            for batch in batches:
                for columns in work(batch):
                    yield pa.RecordBatch.from_pydict(columns)
            if last:
                for columns in work(None):
                    yield pa.RecordBatch.from_pydict(columns)
        finally:
            work = batch = columns = None
            give_back()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


class Workspace:
    """Intermediate tables under the folder the cluster shares (``spark.checkpoint.dir``).

    A written table cuts the lineage: a lost executor costs only the tasks of
    the step that is running. Tables stay until ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
