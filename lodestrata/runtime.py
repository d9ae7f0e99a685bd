"""What running on a cluster takes: the package on the executors, and tables between rounds."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors unless their PYTHONPATH has it."""
    package = Path(__file__).resolve().parent
    context = spark.sparkContext
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_lodestrata", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="lodestrata-")) / "lodestrata.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._lodestrata = True


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder if all tasks share one machine, as in tests, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lodestrata"


def own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def settled(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: lineage ends here, and a lost executor costs no earlier round. The table stays until ``clear``."""
    path = f"{own_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """A small file in one step, unless there is one of that name: written beside and renamed without overwriting."""
    jvm = spark._jvm
    (final, fs), (beside, _) = _at(spark, path), _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(context.makeQualified(beside), context.makeQualified(final), plain)
    except Py4JJavaError as e:
        fs.delete(beside, False)
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def read_small(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """Names and modification times (seconds) of what lies in a folder; none if it isn't there."""
    p, fs = _at(spark, folder)
    return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application's operators have settled; results that were not written elsewhere can't be read after."""
    remove(spark, own_folder(spark))


def write_over(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one step, over the one there is."""
    jvm = spark._jvm
    (final, fs), (beside, _) = _at(spark, path), _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kinds, 1)
    over[0] = kinds.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(context.makeQualified(beside), context.makeQualified(final), over)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def copy_into(spark: SparkSession, path: str, folder: str) -> None:
    """A file copied to a folder under its own name, in one step."""
    (source, fs), (to, there) = _at(spark, path), _at(spark, folder)
    there.mkdirs(to)
    beside, _ = _at(spark, f"{folder}/.{source.getName()}.copying")
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, there, beside, False, True, spark._jsc.hadoopConfiguration())
    there.rename(beside, _at(spark, f"{folder}/{source.getName()}")[0])
