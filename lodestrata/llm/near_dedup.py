"""Near-duplicate documents: BagMinHash signatures, banding, verified multiset overlap.

A document is the multiset of its five-word shingles (lower case). Signatures
estimate weighted Jaccard without bias: each shingle carries Poisson processes
over its weights 0, 1, 2, ..., in dyadic blocks [0,1), [1,2), [2,4), ...; a
point of a block is handed down its halves to one weight level, counts if that
level lies below the shingle's multiplicity, and belongs to one signature
component. A component holds the least point it got. A process stops once its
points lie behind all components' values.

Documents of equal words are one class, for which its smallest doc_id stands.
Classes that share a band are linked in two rounds, and a group's pairs are
never listed:

1. Stars. Each bucket's smallest document is its centre. A document is verified
   against the most similar of its centres and the smallest of those that its
   signature doesn't rule out. Verified links give components.
2. Seams. In every bucket that still has several components, signatures tell
   which documents may have a link into which larger component. Each such
   document is probed against all members of that component at once, through an
   index from shingles to members; big components are probed by chunks. First
   each asks the largest and the most similar one, then all that remain and
   that lengths and shingles of one component only don't rule out.

A candidate pair is in one component after round 1, or its smaller side is
probed in round 2, so no candidate link between components goes unverified.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import _common as C

SHINGLE = 5
#: Members of one chunk of a probed component (shingles), documents of one block of a bucket, and probing documents of one task's share.
CHUNK, BLOCK, SHARE = 500_000, 512, 1024
#: Members of a component whose own shingles are told apart.
SLOTS = 60
_WORDS = re.compile("[^ \t-\r]+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self, memo: int = 200_000):
        self.memo = C.Recent(lambda w: xxhash.xxh64_intdigest(w) or 1, memo)

    def words(self, text: str) -> list[str]:
        return _WORDS.findall(text.lower())

    def hashes(self, words: list[str]) -> np.ndarray:
        """A hash for each shingle; fewer words than a shingle has are one shingle."""
        get, miss = self.memo.new.get, self.memo.miss
        w = np.array([get(x) or miss(x) for x in words], np.uint64)
        n = max(1, len(w) - SHINGLE + 1) if len(w) else 0
        h = np.full(n, len(w) if len(w) < SHINGLE else SHINGLE, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(min(SHINGLE, len(w))):
                h = mix(h * _GOLD + w[k : k + n])
        return h

    def bag(self, words: list[str]) -> np.ndarray:
        """Sorted distinct hashes of (shingle, how many equal ones stand before it): as sets these overlap as the multisets do."""
        h = np.sort(self.hashes(words))
        if not len(h):
            return h
        first = np.concatenate([[True], h[1:] != h[:-1]])
        start = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        with np.errstate(over="ignore"):
            return np.unique(mix(h + _GOLD * (np.arange(len(h)) - start).astype(np.uint64)))


def signatures(bags: list[np.ndarray], m: int, seed: int = 1) -> np.ndarray:
    """BagMinHash signatures (m values a row) of multisets given as arrays of hashes with repeats. Rows of empty multisets are infinite."""
    owner, item, weight = [], [], []
    for i, h in enumerate(bags):
        u, n = np.unique(h, return_counts=True)
        owner.append(np.full(len(u), i))
        item.append(u)
        weight.append(n)
    sig = np.full((len(bags), m), np.inf)
    if not owner:
        return sig
    owner, item, weight = np.concatenate(owner), np.concatenate(item), np.concatenate(weight).astype(np.int64)
    if not len(owner):
        return sig
    blocks = np.ceil(np.log2(weight + 0.0)).astype(np.int64) + 1  # [0,1), [1,2), [2,4), ...: those that begin below the weight
    rows = np.repeat(np.arange(len(item)), blocks)
    block = np.arange(len(rows)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    owner, weight = owner[rows], weight[rows]
    size = np.where(block == 0, 1, 1 << np.maximum(block - 1, 0))
    low = np.where(block == 0, 0, size)
    with np.errstate(over="ignore"):
        state = mix(item[rows] + _GOLD * (block.astype(np.uint64) + np.uint64(seed * 1000)))
    x = np.zeros(len(rows))
    flat = sig.ravel()
    live = np.arange(len(rows))
    while len(live):
        with np.errstate(over="ignore"):
            state_live = state[live] + _GOLD
            state[live] = state_live
            a = mix(state_live)
            b = mix(a + _GOLD)
        x_live = x[live] - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / size[live]
        x[live] = x_live
        level = low[live] + ((b >> np.uint64(40)).astype(np.int64) * size[live] >> 24)
        counts = level < weight[live]
        at = owner[live] * m + (b & np.uint64(0xFFFFFFFF)).astype(np.int64) * m // (1 << 32)
        np.minimum.at(flat, at[counts], x_live[counts])
        most = sig.max(axis=1)
        live = live[x_live <= most[owner[live]]]
    return sig


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    with np.errstate(over="ignore"):
        for k in range(rows):
            h = mix(h * _GOLD + bits[:, :, k])
    return h.view(np.int64)


def prints(sig: np.ndarray) -> np.ndarray:
    """A byte of each signature component: equal where components are, and by chance once in 256."""
    return (mix(sig.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def enough_prints(m: int, similarity: float) -> int:
    """How many of ``m`` components a pair of that similarity shares but for once in 200,000 cases (4.4 standard deviations)."""
    return max(1, int(m * similarity - 4.4 * (m * similarity * (1 - similarity)) ** 0.5))


def _rows(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint8).reshape(-1, width)


def _signed(docs: DataFrame, bands: int, rows: int, extra: int) -> DataFrame:
    """doc_id, c1, c2 (the class: a hash of the words), bands and prints (empty without words)."""

    def make():
        shingler = Shingler()

        def work(batch: pa.RecordBatch):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            a = 0
            while a < len(texts):
                doc, cls, bags, size = [], [], [], 0
                while a < len(texts) and size < 1_000_000:
                    words = shingler.words(texts[a])
                    if ids[a] is not None:
                        doc.append(ids[a])
                        cls.append(xxhash.xxh3_128_digest(" ".join(words)))
                        bags.append(shingler.hashes(words))
                        size += len(words)
                    a += 1
                c = np.frombuffer(b"".join(cls), np.int64).reshape(-1, 2)
                sig = signatures(bags, bands * rows + extra)
                columns = {k: pa.array([r.tobytes() if len(b) else b"" for r, b in zip(v, bags, strict=True)], pa.binary()) for k, v in (("bands", band_hashes(np.ascontiguousarray(sig[:, : bands * rows]), bands, rows)), ("prints", prints(sig)))}
                yield {"doc_id": pa.array(doc, pa.int64()), "c1": pa.array(c[:, 0]), "c2": pa.array(c[:, 1])} | columns

        return work

    return C.map_rows(C.texts(docs), "doc_id long, c1 long, c2 long, bands binary, prints binary", make)


def _buckets(reps: DataFrame, bands: int) -> DataFrame:
    """bucket, doc, centre (the bucket's smallest doc) of all buckets with two documents or more."""

    def make():
        def work(batch: pa.RecordBatch):
            h = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64).reshape(-1, bands)
            yield {"bucket": pa.array(h.ravel()), "doc": pa.array(np.repeat(batch.column("doc").to_numpy(), bands))}

        return work

    every = C.map_rows(reps.select("doc", "bands"), "bucket long, doc long", make)
    return every.repartition("bucket").sortWithinPartitions("bucket", "doc").transform(lambda d: C.map_rows(d, "bucket long, doc long, centre long", _shared_buckets))


def _shared_buckets():
    held: dict = {"bucket": None, "centre": 0, "told": False}  # the bucket that the next batch may go on with

    def work(batch: pa.RecordBatch):
        if not batch.num_rows:
            return
        b, d = batch.column("bucket").to_numpy(), batch.column("doc").to_numpy()
        told = False
        if held["bucket"] is not None:
            b, d, told = np.concatenate([[held["bucket"]], b]), np.concatenate([[held["centre"]], d]), held["told"]
        start = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        size = np.diff(np.concatenate([start, [len(b)]]))
        out = np.repeat(size > 1, size)
        held.update(bucket=b[-1], centre=d[start[-1]], told=bool(size[-1] > 1 or (told and len(start) == 1)))
        if told:
            out[0] = False
        yield {"bucket": pa.array(b[out]), "doc": pa.array(d[out]), "centre": pa.array(np.repeat(d[start], size)[out])}

    return work


def _likely(pairs: DataFrame, m: int, least: int) -> DataFrame:
    """centre, doc, same (equal prints) of the pairs whose signatures agree in ``least`` components or more; rows with centre, doc and both prints come in."""

    def make():
        def work(batch: pa.RecordBatch):
            same = (_rows(batch, "p", m) == _rows(batch, "q", m)).sum(axis=1)
            on = same >= least
            yield {"centre": pa.array(batch.column("centre").to_numpy()[on]), "doc": pa.array(batch.column("doc").to_numpy()[on]), "same": pa.array(same[on].astype(np.int32))}

        return work

    return C.map_rows(pairs, "centre long, doc long, same int", make)


def _bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, bag (sorted 64-bit), n of the rows of ``docs`` that stand for a class in ``wanted`` (doc, c1, c2)."""
    d = C.texts(docs).join(wanted, F.col("doc_id") == F.col("doc"))

    def make():
        shingler = Shingler()

        def work(batch: pa.RecordBatch):
            doc, bag = [], []
            for i, text, c1, c2 in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "c1", "c2")), strict=True):
                words = shingler.words(text)
                if np.frombuffer(xxhash.xxh3_128_digest(" ".join(words)), np.int64).tolist() == [c1, c2]:
                    doc.append(i)
                    bag.append(shingler.bag(words).tobytes())
            yield {"doc": pa.array(doc, pa.int64()), "bag": pa.array(bag, pa.binary()), "n": pa.array([len(x) // 8 for x in bag], pa.int64())}

        return work

    # rows that share a doc_id and its words would stand twice
    return C.map_rows(d.select("doc", "text", "c1", "c2"), "doc long, bag binary, n long", make).dropDuplicates(["doc"])


class Probe:
    """An index from shingles to the members of a chunk, which answers which member a bag is similar to."""

    def __init__(self, docs: list[int], bags: list[np.ndarray]):
        self.docs, self.sizes = np.array(docs, np.int64), np.array([len(b) for b in bags], np.int64)
        every = np.concatenate(bags)
        owner = np.repeat(np.arange(len(bags)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.tokens, self.start = np.unique(every[order], return_index=True)
        self.start = np.concatenate([self.start, [len(every)]])
        self.owner = owner[order]

    def first(self, bag: np.ndarray, similarity: float, own: int) -> int | None:
        """The smallest member of that similarity, but for ``own``."""
        at = np.searchsorted(self.tokens, bag)
        hit = at[self.tokens[np.minimum(at, len(self.tokens) - 1)] == bag]
        if not len(hit):
            return None
        a, n = self.start[hit], self.start[hit + 1] - self.start[hit]
        rows = np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)
        both = np.bincount(self.owner[rows], minlength=len(self.docs))
        ok = (both >= similarity * (self.sizes + len(bag) - both)) & (self.docs != own)
        return int(self.docs[ok].min()) if ok.any() else None


def _bounds(bags: DataFrame, comps: DataFrame) -> DataFrame:
    """doc, n, c (its shingles that another component of ``comps`` (doc, comp) has): no overlap with a document of another component is larger than c.

    Members of components of up to ``SLOTS`` are bits of a number, so that one
    aggregate tells whose shingles lie in one component; in larger ones c is n.
    """
    small = comps.groupBy("comp").agg(F.count("*").alias("k")).filter(F.col("k") <= SLOTS).select("comp")
    slots = comps.join(small, "comp").withColumn("slot", F.row_number().over(Window.partitionBy("comp").orderBy("doc")) - 1)
    named = bags.join(comps, "doc").join(slots.select("doc", "slot"), "doc", "left").select("bag", "comp", F.coalesce(F.expr("shiftleft(1L, slot)"), F.lit(0)).alias("bit"))

    def make():
        def work(batch: pa.RecordBatch):
            bags_, at, size = [], [], 0
            for i, b in enumerate(batch.column("bag")):
                bags_.append(np.frombuffer(b.as_buffer(), np.int64))
                at.append(np.full(len(bags_[-1]), i))
                size += len(bags_[-1])
                if bags_ and (size > 250_000 or i + 1 == batch.num_rows):
                    x = np.concatenate(at)
                    yield {"shingle": pa.array(np.concatenate(bags_))} | {c: pa.array(batch.column(c).to_numpy()[x]) for c in ("comp", "bit")}
                    bags_, at, size = [], [], 0

        return work

    every = C.map_rows(named, "shingle long, comp long, bit long", make)
    alone = every.groupBy("shingle").agg(F.min("comp").alias("comp"), F.max("comp").alias("other"), F.bit_or("bit").alias("bits")).filter("comp = other and bits <> 0")
    alone = alone.groupBy("comp", "bits").agg(F.count("*").alias("k")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    alone = alone.filter("(shiftright(bits, slot) & 1) = 1").groupBy("comp", "slot").agg(F.sum("k").alias("u"))
    alone = slots.join(alone, ["comp", "slot"]).select("doc", "u")
    return bags.join(comps, "doc").select("doc", "n").join(alone, "doc", "left").select("doc", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("c"))


def _possible(rows: DataFrame, similarity: float) -> DataFrame:
    """The rows (bucket, n, c, ...) that may have a partner in their bucket: a pair needs an overlap of ``share`` of both lengths, and neither c is less.

    The shortest of a bucket, and the one with the most of c beyond its own
    part of that, stand for all its documents.
    """
    share = similarity / (1 + similarity)
    room = F.col("c") - share * F.col("n")
    best = rows.groupBy("bucket").agg(F.min("n").alias("n_least"), F.max(room).alias("most_room"))
    fits = (room >= share * F.col("n_least") - 1e-6) & (F.col("most_room") >= share * F.col("n") - 1e-6)
    return rows.join(best, "bucket").filter(fits).drop("n_least", "most_room")


def _linked(members: DataFrame, asks: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """a, b: for each ask (g, q) and chunk of the group's ``members`` (g, m) a member similar to q, if there is one.

    A group's members are dealt to chunks of about ``CHUNK`` shingles, its asks
    to shares of about ``SHARE``; every chunk meets every share in a task.
    """
    held = members.join(bags.withColumnRenamed("doc", "m"), "m").select("g", "m", "bag", "n")
    size = members.join(bags.select(F.col("doc").alias("m"), "n"), "m").groupBy("g").agg(F.ceil(F.sum("n") / CHUNK).alias("chunks"))
    plan = size.join(asks.groupBy("g").agg(F.ceil(F.count("*") / SHARE).alias("shares")), "g")
    spread = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(name)
    left = held.join(plan, "g").select("g", F.pmod(F.xxhash64("m"), "chunks").alias("chunk"), spread("shares", "share"), F.lit(0).alias("role"), F.col("m").alias("doc"), "bag")
    right = asks.join(plan, "g").select("g", spread("chunks", "chunk"), F.pmod(F.xxhash64("q"), "shares").alias("share"), F.col("q").alias("doc"))
    right = right.join(bags.select("doc", "bag"), "doc").select("g", "chunk", "share", F.lit(1).alias("role"), "doc", "bag")
    both = left.unionByName(right).repartition("g", "chunk", "share").sortWithinPartitions("g", "chunk", "share", "role")

    def make():
        held: dict = {"at": None}

        def work(batch: pa.RecordBatch):
            a_out, b_out = [], []
            cols = [batch.column(c).to_pylist() for c in ("g", "chunk", "share", "role", "doc")]
            for g, chunk, share, role, doc, bag in zip(*cols, batch.column("bag"), strict=True):
                h = np.frombuffer(bag.as_buffer(), np.uint64)
                if held["at"] != (g, chunk, share):
                    held.update(at=(g, chunk, share), docs=[], bags=[], probe=None)
                if role == 0:
                    held["docs"].append(doc)
                    held["bags"].append(h.copy())
                    continue
                if not held["docs"]:
                    continue
                if len(held["docs"]) == 1:
                    own = held["bags"][0]
                    small, large = (h, own) if len(h) < len(own) else (own, h)
                    if held["docs"][0] == doc or len(small) < similarity * len(large):
                        continue
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    found = held["docs"][0] if both >= similarity * (len(small) + len(large) - both) else None
                else:
                    if held["probe"] is None:
                        held["probe"] = Probe(held["docs"], held["bags"])
                    found = held["probe"].first(h, similarity, doc)
                if found is not None:
                    a_out.append(doc)
                    b_out.append(found)
            yield {"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())}

        return work

    return C.map_rows(both, "a long, b long", make)


def _seams(rows: DataFrame, m: int, least: int, best: bool, similarity: float = 0.0) -> DataFrame:
    """q, g, same (most equal prints), size (of g): documents that may be similar to a member of the larger component g, of rows (bucket, doc, comp, size, prints, n, c) of buckets that have several components.

    A bucket's documents are dealt to blocks of about ``BLOCK``; each two
    blocks meet in a task. Rows of a task lie by component size, and row r is
    compared with row r + k, for all r at once. Pairs whose overlap, at most the
    smaller c, can't reach ``similarity`` aren't told. With ``best`` a task tells
    of each document the largest and the most similar component only.
    """
    wide = rows.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").select("bucket", "blocks")
    dealt = rows.join(wide, "bucket").withColumn("own", F.pmod(F.xxhash64("doc"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "size", "comp", "doc", "prints", "n", "c").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "size", "comp")

    def make():
        held: list[pa.RecordBatch] = []

        def compare(batch: pa.RecordBatch):
            col = {c: batch.column(c).to_numpy() for c in ("bucket", "lo", "hi", "own", "comp", "doc", "size", "n", "c")}
            p = _rows(batch, "prints", m)
            new = np.zeros(len(p), bool)
            for c in ("bucket", "lo", "hi"):
                new[1:] |= col[c][1:] != col[c][:-1]
            group = np.cumsum(new)
            count = np.bincount(group)[group]
            place = np.arange(len(p)) - np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
            left = count - place  # rows of the group from here on
            across = col["lo"] != col["hi"]
            out = []
            live, k = np.arange(len(p)), 0
            while True:
                k += 1
                live = live[left[live] > k]
                if not len(live):
                    break
                r = live[(col["comp"][live] != col["comp"][live + k]) & ~(across[live] & (col["own"][live] == col["own"][live + k]))]
                r = r[(1 + similarity) * np.minimum(col["c"][r], col["c"][r + k]) >= similarity * (col["n"][r] + col["n"][r + k]) - 1e-6]
                for a in range(0, len(r), 1 << 16):
                    x = r[a : a + (1 << 16)]
                    same = (p[x] == p[x + k]).sum(axis=1)
                    x, same = x[same >= least], same[same >= least]
                    out.append(np.stack([col["doc"][x], col["comp"][x + k], same, col["size"][x + k]], axis=1))
            pairs = np.concatenate(out) if out else np.zeros((0, 4), np.int64)
            # of a document and a component the most similar member tells
            pairs = pairs[np.lexsort((-pairs[:, 2], pairs[:, 1], pairs[:, 0]))]
            first = np.ones(len(pairs), bool)
            first[1:] = (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)
            pairs = pairs[first]
            if best and len(pairs):
                last = np.append(pairs[1:, 0] != pairs[:-1, 0], True)
                orders = (np.lexsort((pairs[:, 2], pairs[:, 0])), np.lexsort((pairs[:, 1], pairs[:, 3], pairs[:, 0])))
                pairs = pairs[np.unique(np.concatenate([o[last] for o in orders]))]
            return {k: pa.array(pairs[:, i]) for i, k in enumerate(("q", "g", "same", "size"))}

        def work(batch: pa.RecordBatch | None):
            if batch is not None and batch.num_rows:
                held.append(batch)
            if not held:
                return
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            if batch is None:
                yield compare(whole)
                return
            # the last group may go on in the next batch
            last = [whole.column(c).to_numpy() for c in ("bucket", "lo", "hi")]
            open_ = np.logical_and.reduce([c == c[-1] for c in last])
            cut = int(np.flatnonzero(~open_)[-1]) + 1 if not open_.all() else 0
            held.append(whole.slice(cut))
            if cut:
                yield compare(whole.slice(0, cut))

        return work

    told = C.map_rows(dealt, "q long, g long, same long, size long", make, last=True)
    return told.groupBy("q", "g").agg(F.max("same").alias("same"), F.max("size").alias("size"))


def components(space: C.Workspace, edges: DataFrame, name: str) -> DataFrame:
    """node, label: the smallest node of each node's component. Alternating large-star and small-star steps; each is a minimum by node and a join."""
    e = space.table(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    step = 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        step += 1
        new = space.table(small, f"{name}-{step}")
        same = new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty()
        space.drop(f"{name}-{step - 1}")
        e = new
        if same:
            return e.select(F.col("v").alias("node"), F.col("u").alias("label"))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = 24, rows: int = 4, extra: int = 96) -> DataFrame:
    """doc_id, class_id (smallest doc_id of equal words), group_id (smallest doc_id linked), kept (doc_id = group_id); one row per row of ``docs``.

    A pair of that similarity shares no band once in 300,000 cases, and its
    signatures rule it out once in 200,000. Documents without a word (null and
    empty ones too) are one class; rows with a null doc_id are alone and kept.
    Rows that share a doc_id share its group. Ties don't matter: the smallest
    doc_id stands. An empty table gives none. Other columns aren't read.
    """
    space = C.Workspace(docs.sparkSession, "near")
    m = bands * rows + extra  # ``extra`` components sharpen the estimate only
    least = enough_prints(m, similarity)
    signed = space.table(_signed(docs, bands, rows, extra), "signed")
    classes = signed.groupBy("c1", "c2").agg(F.min("doc_id").alias("class_id"), F.min("bands").alias("bands"), F.min("prints").alias("prints"))
    classes = space.table(classes, "classes")
    reps = classes.groupBy(F.col("class_id").alias("doc")).agg(F.min(F.struct("c1", "c2", "bands", "prints")).alias("x")).select("doc", "x.*").filter(F.length("bands") > 0)
    reps = space.table(reps, "reps")
    marks = reps.select("doc", "prints")
    buckets = space.table(_buckets(reps, bands), "buckets")

    # 1. stars
    stars = buckets.filter("doc <> centre").select("centre", "doc").distinct()
    stars = stars.join(marks.withColumnRenamed("prints", "p"), "doc").join(marks.select(F.col("doc").alias("centre"), F.col("prints").alias("q")), "centre")
    likely = _likely(stars, m, least).groupBy("doc").agg(F.max(F.struct("same", -F.col("centre"))).alias("x"), F.min("centre").alias("least"))
    asks = likely.select(F.col("doc").alias("q"), F.explode(F.array_distinct(F.array(-F.col("x.col2"), "least"))).alias("g"))
    asks = space.table(asks, "stars")
    near = lambda d: d.join(reps.select("doc", "c1", "c2"), "doc")
    bags = space.table(_bags(docs, near(asks.select(F.explode(F.array("q", "g")).alias("doc")).distinct())), "bags")
    links = space.table(_linked(asks.select("g", F.col("g").alias("m")).distinct(), asks, bags, similarity), "links")
    space.drop("stars")

    # 2. seams
    labels = components(space, links, "labels")
    comps = marks.join(buckets.select("doc").distinct(), "doc").join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "prints", F.coalesce("label", "doc").alias("comp"))
    comps = space.table(comps, "comps")
    sized = lambda d: d.join(d.groupBy("comp").agg(F.count("*").alias("size")), "comp")
    unknown = (F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c"))
    seams = space.table(_seams(buckets.join(sized(comps), "doc").select("bucket", "doc", "comp", "size", "prints", *unknown), m, least, True), "seams")
    now = comps.select("doc", F.col("comp").alias("now"))
    # most links show at the largest and at the most similar component; what is left asks the components that these make
    best = seams.groupBy("q").agg(F.max(F.struct("size", "g")).alias("x"), F.max(F.struct("same", "g")).alias("y"))
    asks = space.table(best.select("q", F.explode(F.array_distinct(F.array("x.g", "y.g"))).alias("g")), "asks-1")
    for turn in (1, 2):
        if asks.isEmpty():
            break
        members = now.select(F.col("now").alias("g"), F.col("doc").alias("m")).join(asks.select("g").distinct(), "g")
        new = asks.select(F.col("q").alias("doc")).unionByName(members.select(F.col("m").alias("doc"))).distinct().join(bags.select("doc"), "doc", "left_anti")
        bags = bags.unionByName(space.table(_bags(docs, near(new)), f"bags-{turn}"))
        found = _linked(members, asks, bags, similarity).unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        found = space.table(found, f"links-{turn}")
        labels = components(space, found, f"labels-{turn}")
        if turn == 1:
            before = now.groupBy("now").agg(F.count("*").alias("k"))
            tried = asks.join(before.withColumnRenamed("now", "g"), "g").select("q", "g", "k")
            new_comps = comps.select("doc", "prints").join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("doc", "prints", F.coalesce("label", "doc").alias("comp"))
            new_comps = space.table(new_comps, "comps-1")
            now = new_comps.select("doc", F.col("comp").alias("now"))
            after = now.groupBy("now").agg(F.count("*").alias("k"))
            parted = buckets.join(now, "doc").groupBy("bucket").agg(F.min("now").alias("c1"), F.max("now").alias("c2")).filter("c1 <> c2").select("bucket")
            parted = space.table(buckets.join(parted, "bucket").select("bucket", "doc"), "parted")
            open_ = parted.select("doc").distinct()
            bags = bags.unionByName(space.table(_bags(docs, near(open_.join(bags.select("doc"), "doc", "left_anti"))), "bags-open"))
            bounds = space.table(_bounds(bags, now.join(open_, "doc", "left_semi").withColumnRenamed("now", "comp")), "bounds")
            may = space.table(_possible(parted.join(bounds, "doc"), similarity), "may")
            rest = _seams(may.join(sized(new_comps), "doc").select("bucket", "doc", "comp", "size", "prints", "n", "c"), m, least, False, similarity).select("q", "g")
            # a component that hasn't grown since it was asked has no more to tell
            rest = rest.join(after.withColumnRenamed("now", "g"), "g").join(tried, ["q", "g", "k"], "left_anti").select("q", "g")
            asks = space.table(rest, "asks-2")
    for name in ("bags", "bags-1", "bags-open", "bags-2", "links", "links-1", "links-2", "asks-1", "asks-2", "comps", "comps-1", "parted", "bounds", "may", "buckets", "seams", "reps"):
        space.drop(name)

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    classed = signed.select("doc_id", "c1", "c2").join(classes.select("c1", "c2", "class_id"), ["c1", "c2"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    classed = classed.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
    out = ids.join(classed, "doc_id", "left")
    group = F.coalesce("label", "class_id", "doc_id")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), group.alias("group_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id; columns as they are."""
    others = near_duplicates(docs, **options).filter("not kept").select(F.col("doc_id").alias("_other")).distinct()
    return docs.join(others, docs["doc_id"].cast("long") == others["_other"], "left_anti")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir))
