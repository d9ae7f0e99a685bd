"""Line, substring and near-duplicate dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import EDGE, by_id, table

from lodestrata.llm import line_dedup, near_dedup, suffix_dedup

R = random.Random(11)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def lines_brute(rows, least=10):
    ws = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(ws).translate(low)
    held = {}
    for d, t in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                held.setdefault(key(x), set()).add(d)
    out = {}
    for d, t in rows:
        ls = (t or "").split("\n")
        stay = [x for x in ls if d is None or not (len(key(x)) >= least and len(held[key(x)]) > 1 and min(held[key(x)]) != d)]
        out[d] = (len(ls), len(ls) - len(stay), sha("\n".join(stay).encode()))
    return out


def test_lines(spark):
    pool = ["  Shared LINE number %d\t" % i for i in range(12)] + ["short", "", "éééééééééé", "éÉéééééééé", "ééééééééé", "A\x0bB long enough", "K is not K, long"]
    rows = [(i, "\n".join(R.choices(pool, k=R.randint(0, 8)))) for i in range(60)] + [e[:2] for e in EDGE]
    docs = table(spark, rows)
    out = line_dedup.drop_lines(docs)
    assert set(docs.columns) | {"_n_lines", "_n_dropped"} == set(out.columns)
    got = {r.doc_id: (r._n_lines, r._n_dropped, sha((r.text or "").encode())) for r in out.collect()}
    assert got == lines_brute(rows)
    kept = line_dedup.keep_first_lines(docs)
    assert kept.columns == docs.columns and all(r.n_chars == len(r.text) for r in kept.collect() if r.text is not None)
    assert line_dedup.drop_lines(docs.limit(0)).count() == 0


def test_lines_with_clashing_names(spark):
    docs = table(spark, [(1, "the same long line"), (2, "The same long line \nx")]).selectExpr("*", "1 AS _gone", "2 AS _gone_id", "3 AS _n_lines", "4 AS n_dropped", "5 AS c0", "6 AS gone")
    kept = line_dedup.keep_first_lines(docs)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text, r._gone, r._gone_id, r._n_lines, r.n_dropped, r.c0, r.gone) for r in kept.collect()} == {(1, "the same long line", 1, 2, 3, 4, 5, 6), (2, "x", 1, 2, 3, 4, 5, 6)}


def test_lines_of_one_id_stay(spark):
    got = line_dedup.drop_lines(table(spark, [(1, "the same long line"), (1, "the same long line"), (2, "x")])).collect()
    assert sorted((r.doc_id, r._n_dropped) for r in got) == [(1, 0), (1, 0), (2, 0)]


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 20000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64))
    mph = line_dedup.Mph.build(keys)
    if n:
        assert sorted(mph.index(keys)) == list(range(len(keys)))


def test_shard_round_trip_and_clash():
    h1, h2 = np.array([5, 5, 7]), np.array([1, 2, 3])
    shard, rest = line_dedup.Shard.build(h1, h2, np.array([2, 3, 4], np.int32), np.array([10, 11, 12]))
    assert rest.tolist() == [1]
    found, n, first = line_dedup.Shard.load(shard.dump()).probe(np.array([5, 5, 7, 9]), np.array([1, 2, 3, 3]))
    assert found.tolist()[:3] == [True, False, True] and n[2] == 4 and first[0] == 10


def spans_brute(rows, n=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            first[b[i : i + n]] = min(first.get(b[i : i + n], d), d)
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        out[d] = (len(b), sum(gone), sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1])), sha(bytes(x for x, y in zip(b, gone, strict=True) if not y)))
    return out


def test_substrings(spark):
    parts = ["abcdefgh" * 9, "the quick brown fox jumps over the lazy dog and more", " ", "xyz" * 20, "é" * 40, "q"]
    rows = [(i, "".join(R.choice(parts) if R.random() < 0.7 else str(R.random()) for _ in range(R.randint(0, 7)))) for i in range(80)]
    rows += [e[:2] for e in EDGE if e[0] is not None] + [(950, "a" * 3000), (951, "a" * 60)]
    docs = table(spark, [*rows, (None, parts[1])])
    got = by_id(suffix_dedup.remove_repeats(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got.pop(None) == (len(parts[1]), 0, 0, sha(parts[1].encode()))
    assert got == spans_brute(rows)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_substrings_of_one_id_stay(spark):
    rows = [(3, "p" * 30 + "qrst" * 20)] * 2
    assert [r.n_removed for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()] == [0, 0]


@pytest.mark.parametrize("texts", [["short", "", None, "x" * 49, "short"], ["short", "p" * 30 + "qrst" * 20, "p" * 30 + "qrst" * 20]])
def test_substrings_of_short_blocks(spark, texts):
    """Blocks without a window have rows too: each text is a partition, and so a block, of its own."""
    rows = list(enumerate(texts))
    docs = table(spark, rows).repartitionByRange(len(rows), "doc_id")
    got = by_id(suffix_dedup.remove_repeats(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == spans_brute(rows)


def test_loser_tree():
    runs = [sorted({bytes(R.choices(b"ab", k=8)) for _ in range(40)}) for _ in range(7)] + [[]]
    coded = []
    for x in runs:
        lcp, tails = suffix_dedup.front_code(np.frombuffer(b"".join(x), np.uint8).reshape(-1, 8))
        coded.append((list(lcp), tails))
    order, lcps, distinct = suffix_dedup.LoserTree(coded, 8).merge()
    at = [iter(x) for x in runs]
    got = [next(at[i]) for i in order]
    assert got == sorted(sum(runs, [])) and distinct == sorted(set(got))
    assert all(lcps[i] == next((j for j in range(8) if got[i][j] != got[i - 1][j]), 8) for i in range(1, len(got)))


def bag(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def groups_brute(rows, similarity=0.8):
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = bags[i], bags[j]
            if a == b or sum((a & b).values()) >= similarity * sum((a | b).values()) > 0:
                x, y = root(i), root(j)
                parent[x if rows[x][0] > rows[y][0] else y] = min(x, y, key=lambda k: rows[k][0])
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def test_near_duplicates(spark):
    rows, k = [], 0
    for g in range(12):
        base = [R.choice(WORDS) + str(R.randint(0, 50)) for _ in range(R.randint(3, 120))]
        for _ in range(R.randint(1, 9)):
            w = list(base)
            for _ in range(R.choice([0, 0, 1, 2, 6])):
                w[R.randrange(len(w))] = "edit" + str(R.randint(0, 99))
            rows.append((k, R.choice([" ", "\n"]).join(w)))
            k += 1
    R.shuffle(rows)
    rows += [e[:2] for e in EDGE if e[0] is not None]
    docs = table(spark, [*rows, (None, "x y z"), (None, None)])
    out = near_dedup.near_duplicates(docs).collect()
    got = {r.doc_id: r.group_id for r in out if r.doc_id is not None}
    assert got == groups_brute(rows)
    assert all(r.kept == (r.doc_id == r.group_id) for r in out if r.doc_id is not None) and sum(r.kept for r in out if r.doc_id is None) == 2
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(got.values())) + 2
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_family_below_the_limit(spark, monkeypatch):
    """Pages of one template, alike but for their own words, are never listed as pairs; links among them are found."""
    n = 240
    template = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(template + [f"own{i}x{j}" for j in range(15)])) for i in range(n)]
    rows += [(n + i, rows[7 * i][1].replace(f"own{7 * i}x14", "changed")) for i in range(20)]
    asked = {}
    table_ = near_dedup.C.Workspace.table

    def noted(self, df, name):
        t = table_(self, df, name)
        asked[name] = t.count() if name.startswith("asks") else 0
        return t

    monkeypatch.setattr(near_dedup.C.Workspace, "table", noted)
    got = by_id(near_dedup.near_duplicates(table(spark, rows)), "group_id")
    assert got == {d: (g,) for d, g in groups_brute(rows).items()}
    assert asked["asks-1"] <= 2 * len(rows) and asked["asks-2"] <= n // 10


def test_bounds(spark, monkeypatch):
    """Shingles that no other component has, in components of one, of some, of more than ``SLOTS`` members."""
    monkeypatch.setattr(near_dedup, "SLOTS", 5)
    r = np.random.default_rng(5)
    bags = {i: np.unique(r.integers(-60, 60, r.integers(1, 40))) for i in range(30)} | {99: np.array([], np.int64)}
    comp = {i: i if i < 8 else 8 + i % 4 if i < 20 else 20 for i in bags}
    d = spark.createDataFrame([(i, bytearray(b.tobytes()), len(b)) for i, b in bags.items()], "doc long, bag binary, n long")
    held = {}
    for i, b in bags.items():
        for x in b:
            held.setdefault(int(x), set()).add(comp[i])
    got = by_id(near_dedup._bounds(d, spark.createDataFrame(list(comp.items()), "doc long, comp long")).withColumnRenamed("doc", "doc_id"), "n", "c")
    assert got == {i: (len(b), len(b) if comp[i] == 20 else sum(len(held[int(x)]) > 1 for x in b)) for i, b in bags.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_possible_keeps_all_partners(spark, seed):
    """A row whose document has a partner at 0.8 in its bucket stays."""
    r = np.random.default_rng(seed)
    rows = []
    for bucket in range(40):
        base = np.arange(r.integers(5, 60))
        for doc in range(r.integers(1, 7)):
            own = 1000 * (doc + 1) + np.arange(r.integers(0, 12))
            rows.append((bucket, doc, set(np.concatenate([r.permutation(base)[: len(base) - r.integers(0, 4)], own]).tolist())))
    c = {(b, d): sum(any(x in s for e, f, s in rows if e == b and f != d) for x in t) for b, d, t in rows}
    alike = {(b, d) for b, d, t in rows for e, f, s in rows if b == e and d != f and len(t & s) >= 0.8 * len(t | s)}
    df = spark.createDataFrame([(b, d, len(t), c[b, d]) for b, d, t in rows], "bucket long, doc long, n long, c long")
    kept = {(x.bucket, x.doc) for x in near_dedup._possible(df, 0.8).collect()}
    assert alike and alike <= kept and len(kept) < len(rows)


def test_signatures_are_unbiased():
    r = np.random.default_rng(3)
    items = r.integers(0, 2**63, 60, dtype=np.uint64)
    a = r.integers(0, 9, 60)
    b = np.maximum(0, a + r.integers(-2, 3, 60))
    s = near_dedup.signatures([np.repeat(items, a), np.repeat(items, b)], 20_000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.015
    assert np.isinf(near_dedup.signatures([items[:0]], 8)).all()


def test_components(spark):
    from lodestrata.llm._common import Workspace

    e = [(1, 2), (2, 3), (7, 9), (9, 8), (20, 21)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.label for r in near_dedup.components(Workspace(spark, "t"), spark.createDataFrame(e, "a long, b long"), "c").collect()}
    assert got[3] == 1 and got[9] == 7 and got[8] == 7 and got[21] == 20 and all(got[101 + i] == 100 for i in range(30))
