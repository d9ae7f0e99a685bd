"""Exact dedup against plain Python."""

import hashlib
from collections import defaultdict

import duckdb
import pytest
from helpers import EDGE, by_id, table

from lodestrata.llm import exact_dedup as E


def plain(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def wanted(rows, keep=max):
    groups = defaultdict(list)
    for r in rows:
        groups[plain(r[1])].append(r[0])
    return {i: (keep(ids), len(ids), i == keep(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}


ROWS = [(k, ["Straße ÄB", "straße Äb", "straße äb", "", None, "One", "ONE", "one ", "x" * 200_000, "X" * 200_000, "İstanbul", "i̇stanbul"][k % 12]) for k in range(200)] + [(1000 + k, f"text {k}") for k in range(50)] + [(5000 + k, "HOT copy") for k in range(400)]
COLUMNS = ("keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("fan_in", [2, 3, 64])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_groups(spark, fan_in, keep):
    got = by_id(E.digest_groups(table(spark, ROWS, parts=9), keep, fan_in), *COLUMNS)
    assert got == wanted(ROWS, max if keep == "largest" else min)


def test_edges(spark):
    rows = [(r[0], r[1]) for r in EDGE if r[0] is not None]
    got = by_id(E.digest_groups(table(spark, EDGE)), *COLUMNS)
    assert got.pop(None)[1:3] == (1, True)
    assert got == wanted(rows)


def test_null_ids_yield(spark):
    got = [tuple(r) for r in E.digest_groups(table(spark, [(None, "a"), (None, "A"), (3, "a"), (None, "b")])).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted(got, key=str) == sorted([(None, 3, 3, False)] * 2 + [(3, 3, 3, True), (None, None, 1, True)], key=str)


def test_repeated_rows_keep_one(spark):
    got = E.digest_groups(table(spark, [(1, "a"), (1, "a"), (1, "b"), (2, "B")], parts=4)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 1, 2, False), (1, 1, 2, True), (1, 2, 2, False), (2, 2, 2, True)]


def test_empty_table(spark):
    assert E.digest_groups(table(spark, []).filter("doc_id = 0")).collect() == []
    assert E.keep_one(table(spark, [])).collect() == []


def test_keep_one_keeps_columns(spark):
    d = table(spark, ROWS).selectExpr("*", "1 AS gone_id", "'z' AS r", "'s' AS sha", "'k' AS key", "5 AS run", "5 AS kept")
    left = E.keep_one(d)
    assert left.columns == d.columns
    want = sorted(i for i, (_, _, kept, _) in wanted(ROWS).items() if kept)
    assert sorted(r.doc_id for r in left.collect()) == want
    assert {(r.r, r.gone_id, r.run) for r in left.collect()} == {("z", 1, 5)}


def test_hash_collisions_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(E.F, "xxhash64", lambda *_: E.F.lit(7).cast("long"))
    assert by_id(E.digest_groups(table(spark, ROWS, parts=5), fan_in=2), *COLUMNS) == wanted(ROWS)


def test_matches_sql(spark):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    cols = "doc_id, keep_id, group_size, kept, text_sha256"
    want = sorted(con.sql(f"select {cols} from ({E.ORACLE})").fetchall())
    assert sorted(tuple(r) for r in E.op13_exact_dedup(spark, data).selectExpr(*cols.split(", ")).collect()) == want


def test_bad_parameters(spark):
    for bad in ({"keep": "first"}, {"fan_in": 1}):
        with pytest.raises(ValueError):
            E.digest_groups(table(spark, []), **bad)
