"""Byte-level BPE and token counts against the libraries; the transducer against plain merging."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from helpers import EDGE, by_id, table
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import bpe_fst, byte_bpe, token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")
MODEL = P.path("piece_bpe_32k.model")
SAMPLES = ["", " ", "  a", "a b", "a  b\n\n c ", "The tion's ndé 日本 🙂🙂", "x" * 300, "\x00\x1c\x85", "▁▁a ▁", "1234 5678", " \t\n ", "don't WE'LL", "<s></s><|endoftext|>", "ab" * 500 + " " * 40]


@pytest.fixture(scope="module")
def lib():
    ranks = {k.encode("latin-1"): v for k, v in byte_bpe.read_ranks(RANKS).items()}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def random_texts(n):
    r = random.Random(3)
    parts = ["  ", " ", "\n", "\t", "ab", "the", "é", "日本", "▁", "12", "!!", "\x85", "\xa0", "²", "🙂", "'s", "tion"]
    return ["".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(n)]


def test_ids_equal_library_and_round_trip(lib):
    bpe = byte_bpe.load(RANKS, P.PATTERN)
    for t in SAMPLES + random_texts(500):
        ids = bpe.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == lib[0].encode_ordinary(t)
        for step in (1, 3, 1000):
            pieces = list(bpe.decode(ids, step))
            assert b"".join(a for a, _ in pieces) == t.encode() and "".join(b for _, b in pieces) == t


@pytest.mark.parametrize("chunk", [1, 2, 5, 1 << 16])
def test_counts_equal_library_whatever_the_chunks(lib, chunk):
    counter = token_counts.Counter(token_counts.load(MODEL).rank, chunk=chunk)
    counter.fst = token_counts.load(MODEL).fst
    counter.word = counter.fst.count
    for t in SAMPLES + random_texts(300):
        assert counter.count(t) == len(lib[1].encode(t)), t


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=40), st.integers(0, 1000))
def test_transducer_equals_merging(text, seed):
    r = random.Random(seed)
    rank = {c: i for i, c in enumerate("abc")}
    for _ in range(12):  # each new token joins two that exist, as a trained vocabulary has it
        t = r.choice(list(rank)) + r.choice(list(rank))
        rank.setdefault(t, len(rank))
    reach = {t: k for t, k in rank.items() if bpe_fst.merge_by_rank(t, rank) == [t]}
    fst = bpe_fst.BpeFst(reach, max_states=20)
    want = bpe_fst.merge_by_rank(text, reach)
    assert fst.encode(text) == want
    assert fst.count(text) == len(want)


def test_utf8_machine_waits_for_whole_characters():
    raw = "aé日🙂".encode()
    m = byte_bpe.Utf8Machine([bytes([b]) for b in range(256)])
    out = [m.feed(np.array([b]))[1] for b in raw]
    assert "".join(out) == "aé日🙂" and out == ["a", "", "é", "", "", "日", "", "", "", "🙂"]
    assert m.due(b"", b"\xc0") == 0 and m.due(b"", b"\xe0\xa0") == 2 and m.due(b"", b"\xed\xa0") == 0


def test_query_rows(spark, lib):
    docs = table(spark, [*enumerate(SAMPLES), (0, ""), *EDGE])
    rows = byte_bpe.encode_documents(docs, RANKS, P.PATTERN).collect()
    assert len(rows) == len(SAMPLES) + 1 + len(EDGE) and all(r.decoded_ok for r in rows)
    got = {r.doc_id: r for r in rows}
    assert got[900].n_tokens == 0 and got[900].ids_sha256 == hashlib.sha256(b"").hexdigest()
    ids = lib[0].encode_ordinary(SAMPLES[5])
    assert got[5].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    n = by_id(token_counts.count_tokens(docs, MODEL, 10), "n_bytes", "n_tokens", "over_limit")
    for i, t in enumerate(SAMPLES):
        k = len(lib[1].encode(t))
        assert n[i] == (len(t.encode()), k, k > 10)
    assert n[900] == (0, 0, False)
    assert byte_bpe.encode_documents(docs.limit(0), RANKS, P.PATTERN).count() == 0 == token_counts.count_tokens(docs.limit(0), MODEL).count()
