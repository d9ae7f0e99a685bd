"""Line dedup by a sharded minimal perfect hash.

1. Each document's distinct line keys are hashed to 128 bits: (h1, h2).
2. Keys in two documents or more are kept with their count and smallest
   doc_id, and sharded by h1. A shard's keys get a minimal perfect hash over
   h1 (``Mph``), which indexes arrays of fingerprints (h2), counts and first
   documents. A shard is one row of a table.
3. The documents' keys probe the arrays: shards and keys meet by (shard,
   salt), arrays first, and keys stream past them.
4. Documents drop the lines found, unless they are the first document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import _common as C


def _mix(h: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """Another 64-bit hash of 64-bit hashes, by seed."""
    with np.errstate(over="ignore"):
        x = h ^ (np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Mph:
    """Minimal perfect hash of distinct 64-bit keys: keys fall into buckets of about four; each bucket, large ones first, looks for a seed that sends its keys to free places (hash and displace)."""

    def __init__(self, seeds: np.ndarray, n: int):
        self.seeds, self.n = seeds, n

    @classmethod
    def build(cls, keys: np.ndarray) -> Mph:
        n = len(keys)
        m = max(1, (n + 3) // 4)
        seeds = np.zeros(m, np.uint32)
        bucket = (_mix(keys, 0) % np.uint64(m)).astype(np.int64)
        size = np.bincount(bucket, minlength=m)
        order = np.argsort(bucket, kind="stable")
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        taken = np.zeros(n, bool)
        for k in range(int(size.max(initial=0)), 0, -1):
            left = np.flatnonzero(size == k)  # buckets of k keys, without a seed yet
            seed = 0
            while len(left):
                seed += 1
                if k == 1 and seed > 64:  # the last places: hand them out, marked by the top bit
                    free = np.flatnonzero(~taken)
                    seeds[left] = free[: len(left)].astype(np.uint32) | np.uint32(1 << 31)
                    taken[free[: len(left)]] = True
                    break
                at = (_mix(keys[order[start[left][:, None] + np.arange(k)]], seed) % np.uint64(n)).astype(np.int64)
                ok = ~taken[at].any(axis=1)
                if k > 1:
                    s = np.sort(at, axis=1)
                    ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                # of buckets that want one place the first gets it
                rows = np.flatnonzero(ok)
                flat = at[rows].ravel()
                _, first = np.unique(flat, return_index=True)
                won = np.zeros(len(flat), bool)
                won[first] = True
                rows = rows[won.reshape(-1, k).all(axis=1)]
                seeds[left[rows]] = seed
                taken[at[rows].ravel()] = True
                left = np.delete(left, rows)
        return cls(seeds, n)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Places from 0 to n - 1: each own key its own, any other key some place."""
        seed = self.seeds[(_mix(keys, 0) % np.uint64(len(self.seeds))).astype(np.int64)]
        at = (_mix(keys, seed.astype(np.uint64)) % np.uint64(max(self.n, 1))).astype(np.int64)
        given = (seed >> np.uint32(31)).astype(bool)
        return np.where(given, (seed & np.uint32((1 << 31) - 1)).astype(np.int64), at)


class Shard:
    """A minimal perfect hash with its fingerprint, count and first-document arrays."""

    def __init__(self, mph: Mph, prints: np.ndarray, counts: np.ndarray, firsts: np.ndarray):
        self.mph, self.prints, self.counts, self.firsts = mph, prints, counts, firsts

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> tuple[Shard, np.ndarray]:
        """The shard, and the rows that it could not hold as their h1 is another key's too (2**-64 a pair)."""
        _, rows = np.unique(h1, return_index=True)
        mph = Mph.build(h1[rows].view(np.uint64))
        at = mph.index(h1[rows].view(np.uint64))
        out = [np.empty(len(rows), a.dtype) for a in (h2, counts, firsts)]
        for new, a in zip(out, (h2, counts, firsts), strict=True):
            new[at] = a[rows]
        return cls(mph, *out), np.setdiff1d(np.arange(len(h1)), rows)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is held, its count and first document."""
        at = self.mph.index(h1.view(np.uint64))
        return self.prints[at] == h2, self.counts[at], self.firsts[at]

    def dump(self) -> bytes:
        return b"".join([np.array([self.mph.n, len(self.mph.seeds)], np.int64).tobytes(), self.mph.seeds.tobytes(), self.prints.tobytes(), self.counts.tobytes(), self.firsts.tobytes()])

    @classmethod
    def load(cls, raw: bytes) -> Shard:
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        at, parts = 16 + 4 * m, []
        for kind, size in ((np.int64, 8), (np.int32, 4), (np.int64, 8)):
            parts.append(np.frombuffer(raw[at : at + size * n], kind))
            at += size * n
        return cls(Mph(np.frombuffer(raw, np.uint32, m, 16), n), *parts)


def line_keys(text: str) -> tuple[list[bytes], list[bytes]]:
    """Raw lines, and their keys (UTF-8). bytes.strip and bytes.lower know ASCII only, as the keys' rule does."""
    raw = text.encode("utf-8")
    return raw.split(b"\n"), [k.strip() for k in raw.lower().split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or sum(b & 0xC0 != 0x80 for b in key) >= least)


def _hashes(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of text, and the 16-byte hash of each of its distinct keys."""
    digest = xxhash.xxh3_128_digest
    found = [{digest(k) for k in line_keys(t)[1] if long_enough(k, least)} for t in texts]
    rows = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    return rows, np.frombuffer(b"".join(b"".join(f) for f in found), np.int64).reshape(-1, 2)


def shared_lines(docs: DataFrame, space: C.Workspace, least: int) -> DataFrame:
    """doc_id, h1, h2: the line keys each document must drop."""
    spark = docs.sparkSession

    def make():
        def work(batch: pa.RecordBatch):
            rows, h = _hashes(batch.column("text").to_pylist(), least)
            yield {"doc_id": batch.column("doc_id").take(pa.array(rows)), "h1": pa.array(h[:, 0]), "h2": pa.array(h[:, 1])}

        return work

    keys = space.table(C.map_rows(C.texts(docs).filter("doc_id is not null"), "doc_id long, h1 long, h2 long", make), "keys")
    # rows that repeat a doc_id are one document: the smallest and largest holder tell, whatever the count
    many = keys.groupBy("h1", "h2").agg(F.count("*").cast("int").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("h1", "h2", "n", "first")
    many = space.table(many, "many")
    per_shard, salts = 1 << 16, 8
    shards = max(8, -(-many.count() // per_shard))

    def build():
        held: dict = {"shard": None, "parts": []}

        def dump():
            a = [np.concatenate([p[i] for p in held["parts"]]) for i in range(4)]
            left = np.arange(len(a[0]))
            out = []
            while len(left):  # once, but for equal h1 of different keys
                shard, rest = Shard.build(*(x[left] for x in a))
                out.append(shard.dump())
                left = left[rest]
            return held["shard"], out

        def work(batch: pa.RecordBatch | None):
            done = []
            if batch is not None:
                s = batch.column("shard").to_numpy()
                cols = [batch.column(c).to_numpy() for c in ("h1", "h2", "n", "first")]
                cuts = np.flatnonzero(np.diff(s)) + 1
                for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True):
                    if a == b:
                        continue
                    if held["shard"] is not None and held["shard"] != s[a]:
                        done.append(dump())
                        held["parts"] = []
                    held["shard"] = int(s[a])
                    held["parts"].append([c[a:b] for c in cols])
            elif held["shard"] is not None:
                done.append(dump())
            yield {"shard": pa.array([s for s, o in done for _ in o], pa.int64()), "arrays": pa.array([x for _, o in done for x in o], pa.binary())}

        return work

    by_shard = many.withColumn("shard", F.pmod("h1", F.lit(shards)))
    by_shard = by_shard.repartition(min(shards, 4000), "shard").sortWithinPartitions("shard")
    arrays = space.table(C.map_rows(by_shard, "shard long, arrays binary", build, last=True), "arrays")

    def probe():
        held: dict = {"at": None, "shards": []}

        def work(batch: pa.RecordBatch):
            at = batch.column("shard").to_numpy() * salts + batch.column("salt").to_numpy()
            raw = batch.column("arrays")
            has = raw.is_valid().to_numpy(zero_copy_only=False)
            h1, h2, doc = (batch.column(c).fill_null(0).to_numpy() for c in ("h1", "h2", "doc_id"))
            out = []
            cuts = np.flatnonzero(np.diff(at)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
                if a == b:
                    continue
                if held["at"] != at[a]:
                    held["at"], held["shards"] = at[a], []
                n = int(has[a:b].sum())  # arrays sort before keys
                held["shards"] += [Shard.load(raw[i].as_py()) for i in range(a, a + n)]
                rows = np.arange(a + n, b)
                for shard in held["shards"]:
                    found, _, first = shard.probe(h1[rows], h2[rows])
                    out.append(rows[found & (first != doc[rows])])
            hit = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield {"doc_id": pa.array(doc[hit]), "h1": pa.array(h1[hit]), "h2": pa.array(h2[hit])}

        return work

    salted = keys.select(F.pmod("h1", F.lit(shards)).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), F.lit(None).cast("binary").alias("arrays"), "h1", "h2", "doc_id")
    tables = arrays.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "arrays", F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), F.lit(None).cast("long").alias("doc_id"))
    both = tables.unionByName(salted).repartition(min(shards * salts, 8000), "shard", "salt").sortWithinPartitions("shard", "salt", F.col("arrays").isNull())
    return C.map_rows(both, "doc_id long, h1 long, h2 long", probe)


def _dropped(docs: DataFrame, least: int) -> DataFrame:
    """``docs`` by place (c0, c1, ...), with the kept text, and n_lines, n_dropped. No name of ``docs`` can clash."""
    space = C.Workspace(docs.sparkSession, "lines")
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    gone = shared_lines(docs.select("doc_id", "text"), space, least).groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))
    placed = docs.toDF(*names)
    d = placed.join(gone, placed[doc_id].cast("long") == gone["doc_id"], "left").drop("doc_id")
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True)) + ", n_lines long, n_dropped long"

    def make():
        digest = xxhash.xxh3_128_digest

        def work(batch: pa.RecordBatch):
            n, lost, kept = [], [], []
            for raw_text, gone in zip(batch.column(text).to_pylist(), batch.column("gone"), strict=True):
                if not gone.is_valid:
                    n.append((raw_text or "").count("\n") + 1)
                    lost.append(0)
                    kept.append(raw_text)
                    continue
                pairs = gone.values
                out = {p.tobytes() for p in np.stack([pairs.field("h1").to_numpy(), pairs.field("h2").to_numpy()], 1)}
                raw, keys = line_keys(raw_text)
                stay = [r for r, k in zip(raw, keys, strict=True) if not (len(k) >= least and digest(k) in out)]
                n.append(len(raw))
                lost.append(len(raw) - len(stay))
                kept.append(b"\n".join(stay).decode("utf-8"))
            columns = {c: batch.column(c) for c in names}
            columns[text] = pa.array(kept, pa.string())
            yield columns | {"n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(lost, pa.int64())}

        return work

    return C.map_rows(d, schema, make)


def drop_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """All columns of ``docs`` with the kept text, and ``_n_lines``, ``_n_dropped``.

    Null text is one empty line and stays null unless something is dropped
    from it (nothing can be). Empty lines and keys of fewer than ``least`` code
    points stay. Rows that share a doc_id are one document: what a line is
    dropped for counts ids, so lines repeated within an id stay. A null doc_id
    neither holds nor loses lines. An empty table gives none; the columns'
    names don't matter but for doc_id and text.
    """
    return _dropped(docs, least).toDF(*docs.columns, "_n_lines", "_n_dropped")


def keep_first_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """``docs`` without the lines that an earlier document holds; a column n_chars follows the text."""
    out = _dropped(docs, least).drop("n_lines", "n_dropped").toDF(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).select("doc_id", "text")
    return drop_lines(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.doc_id, i, line, f.first IS NOT NULL AND f.first <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
