"""Repeated-substring dedup by a distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes over it also starts in a document
of smaller doc_id. Texts are packed into blocks; matches never cross texts.

* Sampling. Of each window of ``length`` bytes the leftmost least hash of its
  ``GRAM``-byte strings is the window's anchor: equal windows have equal
  anchors at equal places. Anchors whose string no other document has are
  dropped (their hashes are exchanged as sorted arrays).
* Contexts. The remaining anchors' suffixes, followed by what stands before
  the anchor, are sorted within the block, front-coded (length of the prefix
  shared with the one before, and the rest) and merged by prefix-aware loser
  trees. Equal contexts show as shared prefixes of full length: all but those
  of the first document are repeats as a whole.
* Windows. Where suffixes with one anchor string have several contexts, these
  are compared window by window, and each context learns which of its windows
  a smaller document has.

Blocks collapse equal strings before they send them, so a passage in a third
of all documents is sent once a block.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import _common as C
from lodestrata.llm.near_dedup import mix

GRAM = 16
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _zip(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unzip(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


class LoserTree:
    """Merges sorted runs of distinct strings of one length, given front-coded.

    Each run's head knows how long a prefix it shares with the last string
    that left the tree. Of two heads the one that shares more is smaller; only
    if both share the same, bytes are compared, from there on, and the loser
    then knows the prefix it shares with the winner.
    """

    def __init__(self, runs: list[tuple[list[int], bytes]], size: int):
        self.runs, self.size = runs, size
        self.at = [0] * len(runs)
        self.pos = [0] * len(runs)
        self.head = [b""] * len(runs)
        self.shared = [0] * len(runs)
        for r in range(len(runs)):
            self._next(r)

    def _next(self, r: int) -> None:
        lcps, tails = self.runs[r]
        i = self.at[r]
        if i == len(lcps):
            self.shared[r] = -1  # behind all others
            return
        lcp, p = lcps[i], self.pos[r]
        q = p + self.size - lcp
        self.head[r] = self.head[r][:lcp] + tails[p:q]
        self.shared[r], self.pos[r], self.at[r] = lcp, q, i + 1

    def _less(self, a: int, b: int) -> bool:
        """Does a's head come before b's? The loser's shared prefix becomes that with the winner."""
        shared = self.shared
        la, lb = shared[a], shared[b]
        if la != lb:
            return la > lb
        if la < 0:
            return a < b
        x, y = self.head[a][la:], self.head[b][la:]
        if x == y:
            win = a < b
            lcp = self.size
        else:
            n = len(x)
            lcp = la + n - (((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) >> 3)
            win = x < y
        shared[b if win else a] = lcp
        return win

    def merge(self) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """The runs' numbers in merged order, the prefix each string shares with the one before, and the distinct strings."""
        k = len(self.runs)
        if k == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), []
        size = 1
        while size < k:
            size *= 2
        loser = [-1] * (2 * size)

        def play(node: int) -> int:
            if node >= size:
                return node - size if node - size < k else -1
            a, b = play(2 * node), play(2 * node + 1)
            if a < 0 or b < 0:
                loser[node] = -1
                return max(a, b)
            win, lose = (a, b) if self._less(a, b) else (b, a)
            loser[node] = lose
            return win

        winner = play(1)
        order, lcps, distinct = [], [], []
        shared, less, step, whole = self.shared, self._less, self._next, self.size
        while shared[winner] >= 0:
            order.append(winner)
            lcps.append(shared[winner])
            if shared[winner] < whole or len(order) == 1:
                distinct.append(self.head[winner])
            step(winner)
            node = (winner + size) >> 1
            while node:
                other = loser[node]
                if other >= 0 and less(other, winner):
                    loser[node], winner = winner, other
                node >>= 1
        return np.array(order, np.int64), np.array(lcps, np.int64), distinct


def front_code(keys: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Shared-prefix lengths and the rests of sorted distinct keys (rows of bytes)."""
    n, size = keys.shape
    lcp = np.zeros(n, np.uint8)
    if n > 1:
        lcp[1:] = (keys[1:] != keys[:-1]).argmax(axis=1)
    return lcp, keys[np.arange(size) >= lcp[:, None]].tobytes()


def pack(block: int, part: int, keys: np.ndarray, docs: np.ndarray) -> dict:
    lcp, tails = front_code(keys)
    return {"block": block, "part": part, "n": len(keys), "lcps": lcp.tobytes(), "tails": _zip(tails), "docs": docs.astype("<i8").tobytes()}


def collapse(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each one's smallest document, and which of them each row is."""
    if not len(keys):
        return keys, docs, np.zeros(0, np.int64)
    flat = np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel()
    order = np.argsort(flat, kind="stable")
    s = keys[order]
    first = np.concatenate([[True], (s[1:] != s[:-1]).any(axis=1)])
    group = np.cumsum(first) - 1
    which = np.empty(len(keys), np.int64)
    which[order] = group
    return s[first], np.minimum.reduceat(docs[order], np.flatnonzero(first)), which


def repeated_windows(keys: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For distinct contexts and each one's first document, as bits: is the window that begins ``o`` bytes before the anchor also in a smaller document?"""
    out = np.zeros(len(keys), np.uint64)
    right, left = keys[:, -2].astype(int) - 1, keys[:, -1].astype(int) - 1
    for o in range(length - GRAM + 1):
        rows = np.flatnonzero((left >= o) & (right >= length - o))
        if len(rows):
            windows = np.concatenate([keys[rows, length : length + o][:, ::-1], keys[rows, : length - o]], axis=1)
            _, least, which = collapse(windows, docs[rows])
            out[rows[docs[rows] > least[which]]] |= np.uint64(1 << o)
    return out


def answers(runs: list[dict], size: int, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each run, by context: the smallest document of all runs' equal contexts, and that document's ``repeated_windows``."""
    order, lcps, distinct = LoserTree([(list(r["lcps"]), _unzip(r["tails"])) for r in runs], size).merge()
    own = [_split(r["docs"], "<i8") for r in runs]
    # the k-th time that a run comes up it brings its k-th key
    by_run = np.argsort(order, kind="stable")
    docs = np.empty(len(order), np.int64)
    docs[by_run] = np.concatenate(own)
    new = lcps < size
    new[0] = True
    group = np.cumsum(new) - 1
    first = np.minimum.reduceat(docs, np.flatnonzero(new))
    family = np.cumsum((lcps < GRAM) | (np.arange(len(lcps)) == 0))[new] - 1
    several = np.flatnonzero((np.bincount(family) > 1)[family])
    keys = np.frombuffer(b"".join(distinct), np.uint8).reshape(-1, size)
    masks = np.zeros(len(first), np.uint64)
    masks[several] = repeated_windows(keys[several], first[several], length)
    out, at = [], 0
    for o in own:
        rows = group[by_run[at : at + len(o)]]
        out.append((first[rows], masks[rows]))
        at += len(o)
    return out


class Block:
    """Texts side by side. ``start``: where each begins, and the end of the last."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.start = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))]).astype(np.int64)
        self.data = _unzip(data)

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each anchor: place, text, first window, number of windows, hash. Windows of one anchor are neighbours."""
        n = len(self.data)
        none = np.zeros(0, np.int64)
        if n < length:
            return none, none, none, none, none.astype(np.uint64)
        half = np.ndarray((n - 7,), "<u8", self.data, strides=(1,))
        with np.errstate(over="ignore"):
            h = mix(half[: n - GRAM + 1] * _GOLD + half[8:])
        low = np.uint64(0xFFFFFFFF)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        span, least, width = length - GRAM + 1, key, 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        count = np.maximum(np.diff(self.start) - length + 1, 0)
        texts = np.flatnonzero(count)
        count = count[texts]
        if not len(texts):
            return none, none, none, none, none.astype(np.uint64)
        window = np.arange(count.sum()) + np.repeat(self.start[texts] - (np.cumsum(count) - count), count)
        place = (least[window] & low).astype(np.int64)
        text = np.repeat(texts, count)
        cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
        return place[cut], text[cut], window[cut], np.diff(np.concatenate([cut, [len(window)]])), h[place[cut]]

    def contexts(self, place: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
        """What follows the anchor (``length`` bytes), what stands before it (backwards), and how much of each lies in the text."""
        back = length - GRAM
        data = np.frombuffer(b"\0" * back + self.data + b"\0" * length, np.uint8)
        right = np.minimum(self.start[text + 1] - place, length)
        left = np.minimum(place - self.start[text], back)
        a = data[place[:, None] + back + np.arange(length)]
        a[np.arange(length) >= right[:, None]] = 0
        b = data[place[:, None] + back - 1 - np.arange(back)]
        b[np.arange(back) >= left[:, None]] = 0
        return np.concatenate([a, b, right[:, None].astype(np.uint8) + 1, left[:, None].astype(np.uint8) + 1], axis=1)


def _split(values: bytes | None, kind: str) -> np.ndarray:
    return np.frombuffer(values or b"", kind)


class SuffixDedup:
    """The operator's steps over one table. ``length`` may be 20 to 79."""

    def __init__(self, docs: DataFrame, length: int = 50, block_bytes: int = 2 << 20):
        self.spark, self.docs, self.length, self.block_bytes = docs.sparkSession, docs, length, block_bytes
        self.space = C.Workspace(self.spark, "suffixes")

    def blocks(self) -> DataFrame:
        """block, ids, sizes, data (compressed)."""
        most = self.block_bytes

        def make():
            from pyspark import TaskContext

            base = TaskContext.get().partitionId() << 32
            made = [0]

            def work(batch: pa.RecordBatch):
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
                held: list[bytes] = []
                keep: list[int] = []

                def full():
                    block = base + made[0]
                    made[0] += 1
                    return {"block": pa.array([block], pa.int64()), "ids": pa.array([np.array(keep, "<i8").tobytes()], pa.binary()), "sizes": pa.array([np.array([len(x) for x in held], "<i8").tobytes()], pa.binary()), "data": pa.array([_zip(b"".join(held))], pa.binary())}

                size = 0
                for i, t in zip(ids, texts, strict=True):
                    raw = t.as_py().encode("utf-8")
                    if size and size + len(raw) > most:
                        yield full()
                        held, keep, size = [], [], 0
                    held.append(raw)
                    keep.append(i)
                    size += len(raw)
                if held:
                    yield full()

            return work

        return self.space.table(C.map_rows(C.texts(self.docs).filter("doc_id is not null"), "block long, ids binary, sizes binary, data binary", make), "blocks")

    def _reply(self, sent: DataFrame, schema: str, make, name: str) -> DataFrame:
        """Groups of rows (part) through ``make()``, a function from a group's rows (dicts) to reply rows; groups stream past one by one."""
        parts = max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = sent.repartition(parts, "part").sortWithinPartitions("part")

        def start():
            answer = make()
            held: list[dict] = []

            def work(batch: pa.RecordBatch | None):
                rows = batch.to_pylist() if batch is not None else []
                out: list[dict] = []
                for r in rows:
                    if held and held[0]["part"] != r["part"]:
                        out += answer(held)
                        held.clear()
                    held.append(r)
                if batch is None and held:
                    out += answer(held)
                yield {k: pa.array([o[k] for o in out], t) for k, t in kinds.items()}

            return work

        kinds = {"block": pa.int64(), "part": pa.int32(), **{k: pa.binary() for k in schema.split()}}
        return self.space.table(C.map_rows(dealt, "block long, part int, " + ", ".join(f"{k} binary" for k in schema.split()), start, last=True), name)

    def _by_block(self, replies: DataFrame, name: str, *fields: str) -> DataFrame:
        """block, and its replies in the order of part."""
        return replies.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", *fields))).alias(name))

    def run(self) -> DataFrame:
        """block, doc_id, n_bytes, n_removed, n_spans, kept: one row per text with an id."""
        length, space = self.length, self.space
        blocks = self.blocks()
        n = max(1, blocks.count())
        bits = max(3, min(16, (n // 4).bit_length()))

        def part_of(h: np.ndarray) -> np.ndarray:
            return (h >> np.uint64(64 - bits)).astype(np.int64)

        # 1. which anchor strings does more than one document have?
        def anchors_of(block: Block):
            place, text, window, count, h = block.anchors(length)
            by = np.lexsort((block.ids[text], h))
            return place, text, window, count, h, by

        def send_hashes():
            def work(batch: pa.RecordBatch):
                for b in batch.to_pylist():
                    block = Block(b["ids"], b["sizes"], b["data"])
                    _, text, _, _, h, by = anchors_of(block)
                    s, d = h[by], block.ids[text][by]
                    once = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])]) if len(s) else np.zeros(0, bool)
                    s = s[once]
                    short = ((s << np.uint64(bits)) >> np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
                    edge = np.searchsorted(part_of(s), np.arange((1 << bits) + 1))
                    some = np.flatnonzero(np.diff(edge))
                    # byte planes of the sorted hashes
                    yield {"block": pa.array(np.full(len(some), b["block"])), "part": pa.array(some.astype(np.int32)), "hashes": pa.array([short[edge[p] : edge[p + 1]].T.tobytes() for p in some], pa.binary())}

            return work

        def find_shared():
            def planes(raw: bytes) -> np.ndarray:
                p = np.frombuffer(raw, np.uint8).reshape(5, -1).astype(np.uint64)
                return p[0] << np.uint64(32) | p[1] << np.uint64(24) | p[2] << np.uint64(16) | p[3] << np.uint64(8) | p[4]

            def answer(rows: list[dict]):
                each = [planes(r["hashes"]) for r in rows]
                u, k = np.unique(np.concatenate(each), return_counts=True)
                shared = u[k > 1]
                for r, h in zip(rows, each, strict=True):
                    hit = shared[np.minimum(np.searchsorted(shared, h), max(len(shared) - 1, 0))] == h if len(shared) else np.zeros(len(h), bool)
                    yield {"block": r["block"], "part": r["part"], "bits": np.packbits(hit).tobytes()}

            return answer

        sent = C.map_rows(blocks, "block long, part int, hashes binary", send_hashes)
        shared = self._reply(sent, "bits", find_shared, "shared")

        def candidates(block: Block, replies: list[dict]):
            """Anchors whose string another document has too, and their order of sending."""
            place, text, window, count, h, by = anchors_of(block)
            s, d = h[by], block.ids[text][by]
            once = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])]) if len(s) else np.zeros(0, bool)
            group = np.cumsum(once) - 1
            edge = np.searchsorted(part_of(s[once]), np.arange((1 << bits) + 1))
            hit = np.zeros(int(once.sum()), bool)
            for r in replies:
                a, z = edge[r["part"]], edge[r["part"] + 1]
                hit[a:z] = np.unpackbits(_split(r["bits"], "u1"), count=z - a).astype(bool)
            rows = np.sort(by[hit[group]]) if len(by) else by
            return place[rows], text[rows], window[rows], count[rows], h[rows]

        def send(block_id: int, keys: np.ndarray, docs: np.ndarray, part: np.ndarray) -> dict:
            out = [pack(block_id, int(p), keys[part == p], docs[part == p]) for p in np.unique(part)]
            return {"block": pa.array([o["block"] for o in out], pa.int64()), "part": pa.array([o["part"] for o in out], pa.int32()), **{k: pa.array([o[k] for o in out], pa.binary()) for k in ("lcps", "tails", "docs")}}

        def key_part(keys: np.ndarray, width: int) -> np.ndarray:
            h = np.zeros(len(keys), np.uint64)
            with np.errstate(over="ignore"):
                for a in range(0, width - width % 8, 8):
                    h = mix(h * _GOLD + np.ascontiguousarray(keys[:, a : a + 8]).view("<u8").ravel())
            return part_of(h)

        # 2. contexts
        width = 2 * length - GRAM + 2

        def send_contexts():
            def work(batch: pa.RecordBatch):
                for b in batch.to_pylist():
                    block = Block(b["ids"], b["sizes"], b["data"])
                    place, text, *_ = candidates(block, b["shared"] or [])
                    keys, docs, _ = collapse(block.contexts(place, text, length), block.ids[text])
                    yield send(b["block"], keys, docs, key_part(keys, GRAM))

            return work

        asked = blocks.join(self._by_block(shared, "shared", "bits"), "block", "left")  # blocks of short texts sent no hashes
        runs = "block long, part int, lcps binary, tails binary, docs binary"

        def merge():
            def answer(rows: list[dict]):
                for r, (first, masks) in zip(rows, answers(rows, width, length), strict=True):
                    yield {"block": r["block"], "part": r["part"], "firsts": first.astype("<i8").tobytes(), "masks": masks.astype("<u8").tobytes()}

            return answer

        contexts = self._reply(C.map_rows(asked, runs, send_contexts), "firsts masks", merge, "contexts")

        # 3. what goes
        def repeated(block: Block, b: dict) -> np.ndarray:
            """Where repeated windows begin."""
            place, text, window, count, _ = candidates(block, b["shared"] or [])
            keys, _, which = collapse(block.contexts(place, text, length), block.ids[text])
            part = key_part(keys, GRAM)
            first, masks = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.uint64)
            for r in b["contexts"] or []:
                rows = np.flatnonzero(part == r["part"])
                first[rows], masks[rows] = _split(r["firsts"], "<i8"), _split(r["masks"], "<u8")
            at = np.arange(count.sum()) + np.repeat(window - (np.cumsum(count) - count), count)
            anchor = np.repeat(np.arange(len(place)), count)
            later = block.ids[text] > first[which]
            bit = (masks[which][anchor] >> (place[anchor] - at).astype(np.uint64)) & np.uint64(1)
            return at[later[anchor] | (bit == 1)]

        def finish():
            def work(batch: pa.RecordBatch):
                for b in batch.to_pylist():
                    block = Block(b["ids"], b["sizes"], b["data"])
                    at = repeated(block, b)
                    cover = np.zeros(len(block.data) + length + 1, np.int32)
                    cover[at] += 1  # no window begins twice
                    cover[at + length] -= 1
                    gone = np.cumsum(cover)[: len(block.data)] > 0
                    data = np.frombuffer(block.data, np.uint8)
                    edge = np.concatenate([gone[:1], gone[1:] & ~gone[:-1]])
                    starts = block.start[:-1]
                    inner = starts[(starts > 0) & (starts < len(gone))]
                    edge[inner] = gone[inner]  # a text's first byte begins a span
                    total = np.concatenate([[0], np.cumsum(gone)])
                    spans = np.concatenate([[0], np.cumsum(edge)])
                    a, z = block.start[:-1], block.start[1:]
                    kept = [data[i:j][~gone[i:j]].tobytes() if total[j] > total[i] else block.data[i:j] for i, j in zip(a, z, strict=True)]
                    yield {"doc_id": pa.array(block.ids), "n_bytes": pa.array(z - a), "n_removed": pa.array(total[z] - total[a]), "n_spans": pa.array(spans[z] - spans[a]), "kept": pa.array(kept, pa.binary())}

            return work

        asked = asked.join(self._by_block(contexts, "contexts", "firsts", "masks"), "block", "left")
        return C.map_rows(asked, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", finish)


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes), kept_sha256.

    Null and empty texts have no bytes. Texts shorter than ``length`` lose
    none. Rows that share a doc_id count as one document, so none of them
    loses bytes to another; each has its row. Rows with a null doc_id neither
    lose nor cause losses. An empty table gives none; other columns aren't read.
    """
    done = SuffixDedup(docs, length).run()
    raw = F.encode("text", "UTF-8")
    size = F.octet_length("text").cast("long")
    rest = C.texts(docs).filter("doc_id is null").select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), raw.alias("kept"))
    return done.unionByName(rest).withColumn("kept_sha256", F.sha2("kept", 256))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
