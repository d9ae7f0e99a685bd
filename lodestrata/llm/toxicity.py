"""Toxicity severity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector shared by all
ordered thresholds. x is the presence of the selected words
and beginnings of words. The expected
severity is the sum over k of P(grade > k).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import _common as C

WORDS = re.compile(r"[^\W\d_]+")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def word_features(word: str) -> list[str]:
    """The whole word (closed by ``$``) and its beginnings of 3 to 7 characters."""
    return [word + "$", *(word[:k] for k in range(3, min(8, len(word))))]


class OrdinalModel:
    def __init__(self, weights: dict[str, float], thetas: list[float], memo: int = 300_000):
        self.names = sorted(weights)
        self.index = {f: i for i, f in enumerate(self.names)}
        self.w = np.array([weights[f] for f in self.names], float)
        self.thetas = np.array(thetas, float)
        self.most, self.memo = memo, {}

    def _ids(self, word: str) -> tuple[int, ...]:
        index = self.index
        if len(self.memo) >= self.most:
            self.memo.clear()
        got = self.memo[word] = tuple(index[f] for f in word_features(word) if f in index)
        return got

    def features(self, text: str) -> list[int]:
        """Selected features present in the text."""
        get, ids, found = self.memo.get, self._ids, set()
        for w in set(WORDS.findall(text.lower())):
            f = get(w)
            if f is None:
                f = ids(w)
            if f:
                found.update(f)
        return sorted(found)

    def exceed(self, text: str) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return _sigmoid(self.w[self.features(text)].sum() - self.thetas)


def fit(rows: np.ndarray, words: np.ndarray, grade: np.ndarray, n_words: int, l2: float = 1e-4, steps: int = 1500, rate: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds. (rows[i], words[i]): word present in row. Adam on the mean log-likelihood with an L2 penalty; the gaps between thresholds are kept positive by their logarithms."""
    n, top = len(grade), int(grade.max())
    reach = [(grade > k).mean() for k in range(top)]
    first = -np.log(max(reach[0], 1e-6) / max(1 - reach[0], 1e-6))
    x = np.concatenate([np.zeros(n_words), [first], np.zeros(top - 1)])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        w, theta = x[:n_words], np.cumsum(np.concatenate([x[n_words : n_words + 1], np.exp(x[n_words + 1 :])]))
        z = np.bincount(rows, w[words], n)
        edge = np.concatenate([np.full((n, 1), -np.inf), theta[None, :] - z[:, None], np.full((n, 1), np.inf)], axis=1)
        cdf = np.where(np.isneginf(edge), 0.0, np.where(np.isposinf(edge), 1.0, _sigmoid(np.where(np.isfinite(edge), edge, 0))))
        at = np.arange(n)
        hi, lo = cdf[at, grade + 1], cdf[at, grade]
        p = np.maximum(hi - lo, 1e-12)
        slope_hi, slope_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        gz = (slope_hi - slope_lo) / n  # of the loss by z
        gtheta = np.zeros(top)
        for k in range(top):
            gtheta[k] = (slope_lo[grade == k + 1].sum() - slope_hi[grade == k].sum()) / n
        tail = np.cumsum(gtheta[::-1])[::-1]  # a change of one gap moves all later thresholds
        g = np.concatenate([np.bincount(words, gz[rows], n_words) + l2 * w, tail[:1], tail[1:] * np.exp(x[n_words + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x[:n_words], np.cumsum(np.concatenate([x[n_words : n_words + 1], np.exp(x[n_words + 1 :])]))


def spread(grade: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Binary labels to severities 0 to 3: thirds of the positives by how many marker features they have."""
    if grade.max() > 1:
        return grade
    cuts = np.unique(np.quantile(marks[grade == 1], [1 / 3, 2 / 3]))
    out = np.where(grade == 1, 1 + np.searchsorted(cuts, marks, "left"), 0)
    return np.searchsorted(np.unique(out), out)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 8000, min_docs: int = 5, min_chi2: float = 20.0) -> OrdinalModel:
    """Fits on about ``max_docs`` labelled documents, chosen by the hash of doc_id. Features enter if at least ``min_docs`` of these have them and their chi-squared statistic against grade > 0 reaches ``min_chi2``.

    labels: doc_id, grade (whole numbers from 0; others and nulls teach
    nothing; of repeated ids the largest grade holds). Equal texts count once.
    If grades are only 0 and 1, ``spread`` orders the positives. Without
    labels, or with one grade only, every document has severity 0.
    """
    space = C.Workspace(docs.sparkSession, "toxicity")
    share = min(1.0, max_docs / max(labels.count(), 1))
    chosen = labels.filter("doc_id is not null and grade >= 0").filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))).groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    # the sample is bounded, so it may be broadcast
    sample = space.table(C.texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("grade").alias("grade")), "sample")

    def make():
        def work(batch: pa.RecordBatch):
            n: dict[str, list[int]] = {}
            for text, grade in zip(batch.column("text").to_pylist(), batch.column("grade").to_pylist(), strict=True):
                for f in {f for w in set(WORDS.findall(text.lower())) for f in word_features(w)}:
                    n.setdefault(f, [0, 0])[grade > 0] += 1
            yield {"f": pa.array(list(n), pa.string()), "good": pa.array([x[0] for x in n.values()], pa.int64()), "bad": pa.array([x[1] for x in n.values()], pa.int64())}

        return work

    sizes = {r["bad"]: r["n"] for r in sample.groupBy((F.col("grade") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
    good, bad = float(sizes.get(False, 0)), float(sizes.get(True, 0))
    if not good or not bad:
        space.drop("sample")
        return OrdinalModel({}, [50.0])
    n = good + bad
    # chi-squared = above / below; a feature that every text has tells nothing
    above = F.lit(n) * F.pow(F.col("bad") * good - F.col("good") * bad, F.lit(2.0))
    below = (F.col("good") + F.col("bad")) * (F.lit(n) - F.col("good") - F.col("bad")) * good * bad
    counts = C.map_rows(sample, "f string, good long, bad long", make).groupBy("f").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    picked = {r["f"]: r["bad"] / bad > r["good"] / good for r in counts.filter((F.col("good") + F.col("bad") >= min_docs) & (below > 0) & (above >= min_chi2 * below)).collect()}
    blank = OrdinalModel(dict.fromkeys(picked, 0.0), [0.0])
    names, index = blank.names, blank.index

    def make_rows():
        model = OrdinalModel(dict.fromkeys(index, 0.0), [0.0])

        def work(batch: pa.RecordBatch):
            yield {"grade": batch.column("grade"), "at": pa.array([model.features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))}

        return work

    got = sorted((r["grade"], r["at"]) for r in C.map_rows(sample, "grade int, at array<int>", make_rows).collect())
    space.drop("sample")
    grade = np.array([g for g, _ in got])
    rows = np.repeat(np.arange(len(got)), [len(a) for _, a in got])
    words = np.array([i for _, a in got for i in a], int)
    mark = np.array([picked[f] and f.endswith("$") for f in names], float)
    w, theta = fit(rows, words, spread(grade, np.bincount(rows, mark[words], len(got))), len(names))
    return OrdinalModel(dict(zip(names, w.tolist(), strict=True)), theta.tolist())


def grade_documents(docs: DataFrame, model: OrdinalModel, flag: float = 0.5) -> DataFrame:
    """doc_id, p_toxic (P(grade > 0)), expected_severity, toxic (p_toxic >= flag).

    Null and empty texts have no words and get the thresholds' own
    probabilities. Rows are independent: repeated rows and ids give repeated
    rows, an empty table gives none, a null doc_id stays null, other columns
    aren't read. Texts count whole.
    """
    weights, thetas = dict(zip(model.names, model.w.tolist(), strict=True)), model.thetas.tolist()

    def make():
        held = OrdinalModel(weights, thetas)

        def work(batch: pa.RecordBatch):
            p = np.array([held.exceed(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(thetas))
            yield {"doc_id": batch.column("doc_id"), "p_toxic": pa.array(p[:, 0]), "expected_severity": pa.array(p.sum(axis=1)), "toxic": pa.array(p[:, 0] >= flag)}

        return work

    return C.map_rows(C.texts(docs), "doc_id long, p_toxic double, expected_severity double, toxic boolean", make)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return grade_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("grade"))))
