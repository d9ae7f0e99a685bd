"""Secret scans: fixed rules, and random-looking strings by two character Markov models.

One model learns random strings, the other ordinary identifiers and words,
both from labelled samples. A candidate (a run of 12 or more identifier or
base64 characters clear of the rules' spans) is a secret if its
log-likelihood ratio reaches ``threshold`` nats, and ``rate`` nats for each
of its characters: the sum alone would grow with the length of anything that
is slightly odd.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left
from collections.abc import Callable, Iterable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import _common as C

KINDS = ("assign", "access", "hex", "random")
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}")
_WORD = re.compile(r"[A-Za-z0-9+/_-]{4,}")

Span = tuple[int, int, int]  # start, index of kind, end


def base_spans(text: str) -> list[Span]:
    """The rules' spans, by start, then kind."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # 32 hex digits lie in a run of candidate characters
    for run in _RUN.finditer(text):
        if run.end() - run.start() >= 32:
            out += [(m.start() + run.start(), 2, m.end() + run.start()) for m in _HEX.finditer(run[0]) if m.end() - m.start() >= 32]
    out.sort()
    return out


def clear_of(spans: list[Span]) -> Callable[[int, int], bool]:
    """Whether start to end overlaps none of the sorted spans, in logarithmic time."""
    starts = [s for s, _, _ in spans]
    ends = list(accumulate((e for _, _, e in spans), max))

    def clear(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return k == 0 or ends[k - 1] <= start

    return clear


def labelled_samples(n: int = 1500, seed: int = 7) -> Iterable[tuple[str, int]]:
    """Drawn samples: 1 for random strings, 0 for identifiers. They keep the models usable where the corpus has no examples."""
    draw = random.Random(seed)
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.digits + "abcdef", string.ascii_lowercase + string.digits)
    words = "get set user name file path index value count list item node table query result buffer stream reader writer config option default session request response handler manager service client server cache thread update delete create insert select where order group limit parse token error message number string object array first last next current total start end time date window frame".split()
    for _ in range(n):
        yield "".join(draw.choices(draw.choice(alphabets), k=draw.randint(12, 64))), 1
        parts = draw.choices(words, k=draw.randint(3, 6))
        form = draw.randrange(4)
        yield (parts[0] + "".join(p.title() for p in parts[1:]) if form == 0 else "_-/"[form - 1].join(parts)), 0
        if form == 1:  # constants, numbers, times, rules of one character
            yield draw.choice("_-/").join(parts).upper(), 0
            yield "".join(draw.choices(string.digits, k=draw.randint(12, 24))), 0
            yield f"20{draw.randint(10, 39)}-{draw.randint(10, 12)}-{draw.randint(10, 28)}T{draw.randint(10, 23)}-{draw.randint(10, 59)}-{draw.randint(10, 59)}", 0
            yield draw.choice(string.ascii_letters + string.digits + "+/_-") * draw.randint(12, 48), 0


class Markov:
    """Two first-order chains over printable ASCII, with a start state; add-half smoothing."""

    SIZE = 96

    def __init__(self, counts: np.ndarray):
        p = counts.astype(float) + 0.5
        p /= p.sum(axis=2, keepdims=True)
        self.gain = np.log(p[1]) - np.log(p[0])

    @classmethod
    def codes(cls, s: str) -> np.ndarray:
        return np.clip(np.frombuffer(("\x1f" + s).encode("latin-1", "replace"), np.uint8).astype(np.int64) - 31, 0, cls.SIZE - 1)

    @classmethod
    def tally(cls, samples: Iterable[tuple[str, int]]) -> np.ndarray:
        """How often each symbol follows each, by label."""
        out = np.zeros((2, cls.SIZE, cls.SIZE), np.int64)
        for s, label in samples:
            c = cls.codes(s)
            np.add.at(out[label], (c[:-1], c[1:]), 1)
        return out

    def ratio(self, s: str) -> float:
        c = self.codes(s)
        return float(self.gain[c[:-1], c[1:]].sum())

    def secret(self, s: str, threshold: float = 10.0, rate: float = 0.5) -> bool:
        return self.ratio(s) >= max(threshold, rate * len(s))


def _weak_labels(text: str) -> Iterable[tuple[str, int]]:
    """Samples of one text: what the rules find is random; its other words are ordinary if they are short of a candidate's length, or short of 20 letters and nothing else."""
    spans = base_spans(text)
    clear = clear_of(spans)
    for s, kind, e in spans:
        if kind:
            yield text[s:e], 1
        else:
            yield _ASSIGN.match(text, s)[2], 1
    for m in _WORD.finditer(text):
        n = m.end() - m.start()
        if (n < 12 or n < 20 and m[0].isalpha()) and clear(m.start(), m.end()):
            yield m[0], 0


def train(docs: DataFrame, max_docs: int = 2000) -> np.ndarray:
    """Follow-counts from ``labelled_samples`` and a sample of about ``max_docs`` documents, chosen by the hash of doc_id. At most 2 * 96 * 96 numbers reach the driver."""
    n = docs.count()
    share = min(1.0, max_docs / max(n, 1))
    sample = C.texts(docs).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def make():
        def work(batch: pa.RecordBatch):
            t = Markov.tally(s for x in batch.column("text").to_pylist() for s in _weak_labels(x))
            at = np.flatnonzero(t)
            yield {"at": pa.array(at), "n": pa.array(t.ravel()[at])}

        return work

    counts = Markov.tally(labelled_samples())
    for row in C.map_rows(sample, "at long, n long", make).groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts.ravel()[row["at"]] += row["n"]
    return counts


def scan(docs: DataFrame, counts: np.ndarray, threshold: float = 10.0, rate: float = 0.5) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans ("kind:start:end", code points, end exclusive).

    Null and empty texts have no spans. Rows are independent: repeated rows
    and ids give repeated rows, an empty table gives none, a null doc_id stays
    null, other columns aren't read. Texts are scanned whole.
    """
    counts = np.ascontiguousarray(counts)

    def make():
        model = Markov(counts)
        memo: dict[str, bool] = {}

        def secret(s: str) -> bool:
            got = memo.get(s)
            if got is None:
                if len(memo) > 50_000:
                    memo.clear()
                got = memo[s] = model.secret(s, threshold, rate)
            return got

        def work(batch: pa.RecordBatch):
            n, sha, every = [], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                clear = clear_of(base)
                more = [(m.start(), 3, m.end()) for m in _RUN.finditer(text) if secret(m[0]) and clear(m.start(), m.end())]
                told = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
                sha.append(hashlib.sha256(",".join(told).encode()).hexdigest())
                spans = sorted(base + more)
                every.append(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans))
                n.append([sum(k == i for _, k, _ in spans) for i in range(4)])
            a = np.array(n, np.int64).reshape(-1, 4)
            yield {"doc_id": batch.column("doc_id"), **{f"n_{k}": pa.array(a[:, i]) for i, k in enumerate(KINDS)}, "base_sha256": pa.array(sha, pa.string()), "spans": pa.array(every, pa.string())}

        return work

    return C.map_rows(C.texts(docs), "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string", make)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return scan(docs, train(docs))
