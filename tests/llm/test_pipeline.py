"""The pipeline's stages one after another, held against plain Python."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from lodestrata.llm import byte_bpe
from test_dedup import groups_brute, lines_brute
from test_rules import base_brute


def test_pipeline_equals_plain_python(spark, tmp_path):
    r = random.Random(2)
    word = lambda: r.choice("bcdfg") + r.choice("aeiou") + r.choice("lmnrs") + r.choice("aeiou") + str(r.randint(0, 9)).translate(str.maketrans("0123456789", "tkpvzhjqwx"))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(i, line(30)) for i in range(4)]
    shared = [line(12) for _ in range(5)]
    rows = []
    for i in range(60):
        text = [line(15) for _ in range(8)]
        if i % 4 == 1:
            text[2] = r.choice(shared)
        if i % 9 == 2:
            text[3] = r.choice(items)[1]
        if i % 7 == 3:
            text = text[:2]  # under 50 words
        rows.append([i, "\n".join(text)])
    for i in range(60, 80):  # near copies: other line ends, so that lines differ and shingles hardly do
        w = rows[i - 60][1].split()
        rows.append([i, "\n".join(" ".join(w[k : k + 23]) for k in range(0, len(w), 23))])
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs = {d: t for d, t in rows if not (base_brute(t)[0] < 50 or 100 * base_brute(t)[4] > 50 * base_brute(t)[0])}
    held = {}
    for d, t in docs.items():
        for x in t.split("\n"):
            held.setdefault(x.strip().lower(), set()).add(d)
    assert lines_brute(list(docs.items()))
    docs = {d: "\n".join(x for x in t.split("\n") if len(x.strip()) < 10 or min(held[x.strip().lower()]) == d) for d, t in docs.items()}
    group = groups_brute(list(docs.items()))
    docs = {d: t for d, t in docs.items() if group[d] == d}

    def holds(t, item):
        grams = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
        a, b = grams(item.split()), grams(t.split())
        return len(a & b) >= 0.8 * len(a)

    docs = {d: t for d, t in docs.items() if not any(holds(t, x) for _, x in items)}
    ranks = {k.encode("latin-1"): v for k, v in byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")).items()}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in docs.items():
        ids = lib.encode_ordinary(t)
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert got == want and 20 < len(want) < 60


def test_odd_rows(spark, tmp_path):
    """Null, empty, white, very long and repeated rows, columns of clashing names, and tables without rows."""
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    good = [(i, "\n".join(words(15) for _ in range(6)), "en", "s", 0) for i in range(4)]
    huge = (50, "\n".join(words(20) for _ in range(3000)), "en", None, 0)
    rows = [*good, good[2], huge, (60, None, None, None, None), (61, "", "en", "s", 0), (62, " \n\t", "en", "s", 3), (None, words(80), "en", "s", 1), (63, "word " * 3000, "en", "s", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d = d.selectExpr("*", "1 AS h", "'x' AS gone", "2 AS block", "3 AS part", "4 AS item", "5 AS kept", "6 AS _other", "7 AS _bad", "8 AS row", "9 AS ids", "'y' AS class_id")
    bench = spark.createDataFrame([(1, words(20)), (2, None), (3, "")], "item_id long, text string")
    for name, docs, items in (("all", d, bench), ("none", d.filter("doc_id = -1"), bench), ("no items", d, bench.filter("item_id = -1"))):
        folder = str(tmp_path / name)
        docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
        items.write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        # a row without an id is no duplicate of anything and stays; rows that repeat a document go the same way
        assert sorted((x.doc_id for x in got), key=str) == ([] if name == "none" else sorted([None, 0, 1, 2, 2, 3, 50], key=str))
        texts = {x[0]: x[1] for x in rows}
        assert all(x.decoded_sha256 == hashlib.sha256(texts[x.doc_id].encode()).hexdigest() for x in got)
