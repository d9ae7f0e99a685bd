"""Reading and writing a library of meetings: documents, metadata, manifests, rosters, glossaries, name maps."""

from __future__ import annotations

import hashlib
import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import SPACES, safe, slug
from lodestrata.functions.vectors import norm, unit
from lodestrata.runtime import copy_into, exists, read_small, ship, write_over

SEGMENT = "struct<start:double,end:double,window:int,local_speaker:string,speaker:string,text:string,global:string,speaker_name:string>"
DOCUMENT = f"audio string, duration_s double, window_s double, n_windows int, coverage double, segments array<{SEGMENT}>"
#: Endings of files that may hold a recording, in any case. Fixed values.
AUDIO = ("mp3", "wav", "m4a", "flac", "ogg", "opus", "aac", "wma", "mp4", "mkv", "mov", "webm", "aiff")


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """path, size of the recordings that lie directly in the folder, by path."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", F.col("length").alias("size"))
    return d.filter(F.lower("path").rlike(r"\.(" + "|".join(AUDIO) + ")$")).orderBy("path")


def meeting_id(path: Column) -> Column:
    """What stands behind the last hyphen of the folder a file lies in."""
    return F.element_at(F.split(F.element_at(F.split(path, "/"), -2), "-"), -1)


def read_segments(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Segments of transcript documents; ``win``, ``gid`` and so on stand for words that SQL reserves. A legacy G-1 is no speaker."""
    d = spark.read.schema(DOCUMENT).option("multiLine", True).json(paths).select(meeting_id(F.col("_metadata.file_path")).alias("meeting_id"), F.posexplode("segments").alias("seg_idx", "s"))
    gid = F.when(F.col("s.global").startswith("G-"), None).otherwise(F.col("s.global"))
    return d.select("meeting_id", F.col("seg_idx").cast("long").alias("seg_idx"), F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), F.col("s.window").alias("win"), F.col("s.local_speaker").alias("local_label"), "s.speaker", "s.text", gid.alias("gid"), F.col("s.speaker_name").alias("person"))


def write_segments(segments: DataFrame, path: str) -> None:
    """One JSON document for each meeting, its segments in order."""
    s = F.struct("seg_idx", F.col("start_s").alias("start"), F.col("end_s").alias("end"), F.col("win").alias("window"), F.col("local_label").alias("local_speaker"), "text", F.col("gid").alias("global"), F.col("person").alias("speaker_name"))
    segments.groupBy("meeting_id").agg(F.sort_array(F.collect_list(s)).alias("segments")).write.partitionBy("meeting_id").json(path)


def read_centroids(clusters: DataFrame) -> DataFrame:
    """Clusters fit for the store: no leftover buckets, no zero vectors, unit length."""
    return clusters.filter(~F.col("cluster").startswith("G-") & (norm(F.col("v")) > 0)).withColumn("v", unit(F.col("v")))


def read_meetings(spark: SparkSession, library: str) -> DataFrame:
    """folder, meeting_id, fields (map): each meeting.json, by folder; a broken one has no fields."""
    raw = spark.read.text(f"{library}/*/meeting.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    fields = F.coalesce(F.from_json("value", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return raw.select(F.element_at(F.split("path", "/"), -2).alias("folder"), meeting_id(F.col("path")).alias("meeting_id"), fields.alias("fields")).orderBy("folder")


def merge_fields(old: Column, new: Column) -> Column:
    """Shallow merge of two maps, the new one's values first."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def new_folders(titles: DataFrame, taken: DataFrame, alphabet: str = "abcdefghjkmnpqrstuvwxyz23456789", length: int = 8, most_rounds: int = 50) -> DataFrame:
    """title, meeting_id, folder, one row for each row of ``titles``: ids derived from the title, its number among equal titles, and a counter; those in ``taken`` (meeting_id) or given twice are tried again. If ids run out, an error."""

    def derived(n: int) -> Column:
        h = [F.pmod(F.xxhash64("title", "copy", F.lit(n), F.lit(i)), F.lit(len(alphabet))).cast("int") + 1 for i in range(length)]
        return F.concat(*(F.substring(F.lit(alphabet), x, F.lit(1)) for x in h))

    rows = titles.select("title", F.row_number().over(Window.partitionBy("title").orderBy(F.lit(1))).alias("copy"))
    left, done = rows, None
    for n in range(most_rounds):
        d = left.withColumn("meeting_id", derived(n))
        d = d.withColumn("k", F.row_number().over(Window.partitionBy("meeting_id").orderBy("title", "copy")))
        known = taken.select("meeting_id") if done is None else taken.select("meeting_id").unionByName(done.select("meeting_id"))
        ok = d.filter("k = 1").join(known, "meeting_id", "left_anti").select("title", "copy", "meeting_id")
        done = ok if done is None else done.unionByName(ok)
        left = rows.join(done, ["title", "copy"], "left_anti")
        if left.isEmpty():
            return done.select("title", "meeting_id", F.concat(slug(F.col("title")), F.lit("-"), "meeting_id").alias("folder"))
    raise ValueError(f"no free id for some titles in {most_rounds} rounds")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """key, glossary, roster of a manifest {file: "terms" or {glossary, roster}}; an entry counts for the file's name and its stem."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "entry"))
    e = F.from_json("entry", "struct<glossary:string,roster:array<string>>")
    is_struct = F.col("entry").startswith("{")
    d = raw.select("key", F.when(is_struct, e["glossary"]).otherwise(F.col("entry")).alias("glossary"), F.when(is_struct, e["roster"]).alias("roster"))
    stem = F.regexp_replace("key", r"\.[^.]+$", "")
    return d.select(F.explode(F.array_distinct(F.array("key", stem))).alias("key"), "glossary", "roster")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """key (a meeting's id or title), name."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("key", "names"))
    return raw.select("key", F.explode("names").alias("name"))


def read_glossary(spark: SparkSession, path: str, comments: bool = False) -> str:
    """The file's terms in one line, in its order. As a glossary of its own: without blank lines and lines behind #, joined by commas. ``comments``, as in a manifest: only blank lines go, ends are trimmed, and a space follows each comma."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "line")).withColumn("t", F.btrim("line", F.lit(SPACES))).filter("t <> ''")
    kept = lines.withColumn("x", F.col("t")) if comments else lines.filter(~F.col("t").startswith("#")).withColumn("x", F.col("line"))
    joined = F.expr(f"listagg(x, '{', ' if comments else ','}') WITHIN GROUP (ORDER BY i)")
    return kept.agg(F.coalesce(joined, F.lit("")).alias("g")).first().g


def glossary_of(spark: SparkSession, given: str) -> str:
    """Terms as given, or those of the file that is meant; what looks like a path (a slash, .txt or .list) but isn't there is an error, as it would be taken for a term."""
    if given and exists(spark, given):
        return read_glossary(spark, given)
    if "/" in given or given.endswith((".txt", ".list")):
        raise FileNotFoundError(f"no glossary file at {given}")
    return given


def glossary_union(*terms: Column) -> Column:
    """Terms (arrays) of several glossaries one behind another, repeated ones too; null counts as empty."""
    return F.concat(*(F.coalesce(t, F.array().cast("array<string>")) for t in terms))


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """stem, title of a JSON object."""
    m = F.from_json("value", "map<string,string>")
    return spark.read.text(path, wholetext=True).select(F.explode(m).alias("stem", "title"))


def titled(files: DataFrame, titles: DataFrame) -> DataFrame:
    """path, title: by the file's stem, made safe; without an entry the stem itself."""
    name = F.element_at(F.split("path", "/"), -1)
    d = files.select("path", F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("_stem")).withColumn("stem", safe(F.col("_stem")))
    return d.join(titles.select("stem", "title"), "stem", "left").select("path", F.coalesce("title", "_stem").alias("title"))


def read_reference(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """meeting_id, speaker, start_s, end_s: turns of reference transcripts, a JSON array in each meeting's folder."""
    d = spark.read.schema("speaker string, start double, end double").option("multiLine", True).json(paths)
    return d.select(meeting_id(F.col("_metadata.file_path")).alias("meeting_id"), "speaker", F.col("start").alias("start_s"), F.col("end").alias("end_s"))


def transcript_path(spark: SparkSession, given: str) -> str:
    """The JSON document meant by its own name, its text's name, or the bare stem; an error if there is none."""
    jvm = spark.sparkContext._jvm
    there = lambda p: (x := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(x)
    path = given[:-4] + ".json" if given.lower().endswith(".txt") else given
    if not path.endswith(".json") and not there(path):
        path += ".json"
    if not there(path):
        raise FileNotFoundError(f"no transcript at {path}")
    return path


def name_map(labels: DataFrame) -> DataFrame:
    """meeting_id, names: map of G00, G01, ... to full names."""
    return labels.filter("person is not null").select("meeting_id", "gid", "person").distinct().groupBy("meeting_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("gid", "person")))).alias("names"))


def write_listing(meetings: DataFrame, path: str) -> None:
    """folder, meeting_id, title as tab-separated text."""
    meetings.select("folder", "meeting_id", F.coalesce(F.col("fields")["title"], F.lit("")).alias("title")).write.csv(path, sep="\t")


def inbox(spark: SparkSession, folder: str, archive: str | None, schema: str = DOCUMENT) -> DataFrame:
    """A stream of arriving transcript documents; files that a finished batch has read move to ``archive``. Without an archive they stay, and the stream's checkpoint knows them."""
    d = spark.readStream.schema(schema).option("multiLine", True)
    if archive is not None:
        d = d.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return d.json(folder)


def stage(spark: SparkSession, paths: list[str], folder: str) -> list[str]:
    """Puts files on a worklist folder and gives their names: those of another folder are copied, so the originals stay; those that lie in it already are not. Two files of one name are an error."""
    here = folder.rstrip("/")
    names = [p.rsplit("/", 1)[-1] for p in paths]
    if len(set(names)) < len(names):
        raise ValueError("two files of one name")
    for p in paths:
        if p.rsplit("/", 1)[0] != here:
            copy_into(spark, p, here)
    return names


def status(recordings_: DataFrame, coverage_min: float = 0.95) -> DataFrame:
    """path, status, short: what became of each recording.

    By duration_s (null: unreadable), n_segments (none: empty), embedded
    (false: failed), rendered (false: broken) and coverage (under
    ``coverage_min``: short); else ok. The first of these that holds is the
    status; ``short`` is told beside it, as a short transcript goes on. The
    columns embedded and rendered may be missing.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(True)) if c in recordings_.columns else F.lit(True)
    none = F.coalesce("n_segments", F.lit(0)) == 0
    short = F.coalesce(F.col("coverage") < coverage_min, F.lit(False)) & F.col("duration_s").isNotNull() & ~none
    s = F.when(F.col("duration_s").isNull(), "unreadable").when(none, "empty").when(~flag("embedded"), "failed").when(~flag("rendered"), "broken").when(short, "short").otherwise("ok")
    return recordings_.select("path", s.alias("status"), short.alias("short"))


def status_counts(told: DataFrame) -> DataFrame:
    """status, n, short: how many recordings ended how, and how many of them are short."""
    return told.groupBy("status").agg(F.count("*").alias("n"), F.count_if("short").alias("short"))


def _arrays(content: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def read_vectors(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """meeting_id, seg_idx, v of legacy vector files (emb: n x d, seg_idx: n), one a meeting. Files are opened where they are read; rows of objects are refused."""

    def run(batches):
        for b in batches:
            for meeting, content in zip(b["meeting_id"], b["content"], strict=True):
                z = _arrays(content)
                yield pd.DataFrame({"meeting_id": meeting, "seg_idx": z["seg_idx"].astype(np.int64), "v": pd.Series(list(z["emb"].astype(np.float32)), dtype=object)}, columns=["meeting_id", "seg_idx", "v"])

    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select(meeting_id(F.col("path")).alias("meeting_id"), "content")
    return files.mapInPandas(run, "meeting_id string, seg_idx long, v array<float>")


def read_cluster_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """meeting_id, cluster, v, seconds of legacy cluster files (centroid, cluster, secs), fit for the store: see ``read_centroids``."""

    def run(batches):
        for b in batches:
            for meeting, content in zip(b["meeting_id"], b["content"], strict=True):
                z = _arrays(content)
                yield pd.DataFrame({"meeting_id": meeting, "cluster": z["cluster"].astype(str), "v": pd.Series(list(z["centroid"].astype(np.float64)), dtype=object), "seconds": z["secs"].astype(np.float64)}, columns=["meeting_id", "cluster", "v", "seconds"])

    ship(spark)
    files = spark.read.format("binaryFile").load(paths).select(meeting_id(F.col("path")).alias("meeting_id"), "content")
    return read_centroids(files.mapInPandas(run, "meeting_id string, cluster string, v array<double>, seconds double"))


def update_meeting(spark: SparkSession, folder: str, **fields) -> dict:
    """Merges fields into a meeting's own document and gives it; a broken or missing one counts as empty, what isn't named stays."""
    path = f"{folder.rstrip('/')}/meeting.json"
    try:
        old = json.loads(read_small(spark, path)) if exists(spark, path) else {}
    except ValueError:
        old = {}
    new = (old if isinstance(old, dict) else {}) | fields
    write_over(spark, path, json.dumps(new, ensure_ascii=False, indent=1))
    return new


def digest(raw: bytes) -> str:
    """What tells whether a cluster's vector is unchanged."""
    return hashlib.sha256(raw).hexdigest()
