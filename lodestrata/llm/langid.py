"""Language identification with word-first backoff.

A word the model knows scores by its log frequency in each language. An unseen
word falls back to the longest character n-grams of it (bounded by ``^`` and
``$``) of which any is known: it scores by their mean log frequency.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import _common as C

WORDS = re.compile(r"[^\W\d_]+")
LONGEST = 4


def grams(word: str, n: int) -> list[str]:
    w = f"^{word}$" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class Model:
    """``tables``: by length (0 for words) by unit, its count in each of ``langs``; ``totals``: by length the units in each language, kept or not."""

    def __init__(self, langs: list[str], tables: dict[int, dict[str, list[int]]], totals: dict[int, list[int]], memo: int = 300_000):
        self.langs, self.most = langs, memo
        self.logs: dict[int, dict[str, np.ndarray]] = {}
        for n, table in tables.items():
            if not table:
                continue
            counts = np.array(list(table.values()), float) + 0.1
            logs = (np.log(counts) - np.log(np.array(totals[n], float) + 0.1 * (len(table) + 1))).astype(np.float32)
            self.logs[n] = dict(zip(table, logs, strict=True))
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.langs)), np.float32)

    def score(self, word: str) -> np.ndarray:
        got = self.logs.get(0, {}).get(word)
        if got is not None:
            return got
        for n in range(LONGEST, 0, -1):
            table = self.logs.get(n)
            if table:
                known = [table[g] for g in grams(word, n) if g in table]
                if known:
                    return np.mean(known, axis=0)
        return np.zeros(len(self.langs), np.float32)

    def _row(self, word: str) -> int:
        i = len(self.row)
        if i == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[i] = self.score(word)
        self.row[word] = i
        return i

    def predict(self, text: str) -> tuple[str, float]:
        words = WORDS.findall(text.lower())
        if not words or not self.langs:
            return "und", 0.0
        if len(self.row) > self.most:
            self.clear()
        get, new = self.row.get, self._row
        at = [i if (i := get(w)) is not None else new(w) for w in words]
        total = self.scores[at].sum(axis=0, dtype=np.float64)
        p = np.exp(total - total.max())
        best = int(p.argmax())  # ties: the language that sorts first
        return self.langs[best], float(p[best] / p.sum())


def train(docs: DataFrame, max_docs: int = 1500, max_units: int = 10_000) -> tuple:
    """A model's parts from about ``max_docs`` documents of each language, chosen by the hash of doc_id, with the ``max_units`` most frequent words and n-grams of each length kept for each language (ties: the unit that sorts first). Rows without text or lang teach nothing."""
    known = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(n)
    share = F.lit(0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(int(min(1.0, max_docs / n[lang]) * (1 << 30)))).otherwise(share)
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share)

    def make():
        def work(batch: pa.RecordBatch):
            words: dict[str, Counter] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORDS.findall(text.lower()))
            count: Counter = Counter()
            for lang, found in words.items():
                for w, k in found.items():
                    count[lang, 0, w] = k
                    for m in range(1, LONGEST + 1):
                        for g in grams(w, m):
                            count[lang, m, g] += k
            keys = list(count)
            yield {"lang": pa.array([k[0] for k in keys], pa.string()), "m": pa.array([k[1] for k in keys], pa.int32()), "unit": pa.array([k[2] for k in keys], pa.string()), "n": pa.array(list(count.values()), pa.int64())}

        return work

    units = C.map_rows(sample, "lang string, m int, unit string, n long", make).groupBy("lang", "m", "unit").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("lang", "m")
    kept = units.withColumn("total", F.sum("n").over(by)).withColumn("k", F.row_number().over(by.orderBy(F.desc("n"), "unit"))).filter(F.col("k") <= max_units).select("lang", "m", "unit", "n", "total").collect()
    tables: dict[int, dict[str, list[int]]] = {}
    totals: dict[int, list[int]] = {}
    for r in sorted(kept):
        i = langs.index(r["lang"])
        tables.setdefault(r["m"], {}).setdefault(r["unit"], [0] * len(langs))[i] = r["n"]
        totals.setdefault(r["m"], [0] * len(langs))[i] = r["total"]
    return langs, tables, totals


def identify(docs: DataFrame, parts: tuple) -> DataFrame:
    """doc_id, lang_pred, score (the posterior of the language under equal priors).

    A text that is null or has no letter, or any text under a model that has
    learned nothing, is ``und`` with score 0. Rows are independent: repeated
    rows and ids give repeated rows, an empty table gives none, a null doc_id
    stays null, other columns aren't read. Texts count whole.
    """
    packed = pickle.dumps(parts)

    def make():
        model = Model(*pickle.loads(packed))

        def work(batch: pa.RecordBatch):
            got = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("doc_id"), "lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())}

        return work

    return C.map_rows(C.texts(docs), "doc_id long, lang_pred string, score double", make)


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    parts = train(docs.filter(~F.coalesce(held_out("doc_id"), F.lit(False))))
    return identify(docs, parts).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
