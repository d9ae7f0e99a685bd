"""Token counts by a compiled transducer: counts annotate the transitions, chunks compose.

``Counter`` runs the BPE transducer of a published SentencePiece BPE model and
adds up how many tokens each transition emits (a symbol outside the
vocabulary counts its UTF-8 bytes). No piece holds a space mark behind
another character, so at every such place the transducer is in its start
state, whatever came before. A chunk's state map is therefore ``(head,
count, tail)``: what stands before its first such place (how much that costs
depends on the state it is entered in), tokens of all that is fixed, and what
stands behind its last one, which decides the state it is left in. ``compose``
is associative; ``prefix_scan`` composes all chunks of a text in pairs.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import _common as C
from lodestrata.llm.bpe_fst import BpeFst

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_CUT = re.compile(f"(?<=[^{MARK}]){MARK}")


class ChunkMap(NamedTuple):
    """cut: whether the chunk has a place where the start state is certain; if not, all of it is in head."""

    cut: bool
    head: str
    count: int
    tail: str


def read_model(path: str) -> dict[str, int]:
    """Piece to rank (0 merges first) of a SentencePiece BPE model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids.sort(key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): r for r, i in enumerate(ids)}


class Counter:
    def __init__(self, rank: dict[str, int], memo: int = 600_000, chunk: int = 1 << 16):
        self.rank, self.chunk = rank, chunk
        self.fst = BpeFst(rank, lambda token: 1 if token in rank else len(token.encode("utf-8")), max_states=250_000)
        self.word = self.fst.count  # tokens of a stretch that starts at the start state
        self.memo = C.Recent(lambda word: self.word(MARK + word), memo)

    def chunk_map(self, part: str) -> ChunkMap:
        """``part``: of a text whose spaces are marks."""
        first = _CUT.search(part)
        if first is None:
            return ChunkMap(False, part, 0, "")
        head, body = part[: first.start()], part[first.start() :]
        if MARK + MARK in body:
            words = _WORDS.findall(body)
            tail = words.pop()
            return ChunkMap(True, head, sum(map(self.word, words)), tail)
        words = body.split(MARK)
        get, miss = self.memo.new.get, self.memo.miss
        count = sum([get(w) or miss(w) for w in words[1:-1]])
        return ChunkMap(True, head, count, MARK + words[-1])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of a's text followed by b's."""
        if not b.cut:
            if not a.cut:
                return self.chunk_map(a.head + b.head)
            joined = a.tail + b.head
            inner = self.chunk_map(joined)
            return ChunkMap(True, a.head, a.count, joined) if not inner.cut else ChunkMap(True, a.head, a.count + self.word(inner.head) + inner.count, inner.tail)
        if not a.cut:
            inner = self.chunk_map(a.head + b.head)
            # b's body starts with a mark; whether its place is certain depends on what stands before it
            if not inner.cut:
                return ChunkMap(True, a.head + b.head, b.count, b.tail)
            return ChunkMap(True, inner.head, inner.count + self.word(inner.tail) + b.count, b.tail)
        middle = a.tail + b.head
        inner = self.chunk_map(middle)
        n = self.word(middle) if not inner.cut else self.word(inner.head) + inner.count + self.word(inner.tail)
        return ChunkMap(True, a.head, a.count + n + b.count, b.tail)

    def prefix_scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """All maps composed, neighbours in pairs: the depth is the logarithm of their number."""
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        size = self.chunk
        whole = self.prefix_scan([self.chunk_map(text[i : i + size]) for i in range(0, len(text), size)])
        if not whole.cut:
            return self.word(whole.head)
        return (self.word(whole.head) if whole.head else 0) + whole.count + self.word(whole.tail)


def load(path: str) -> Counter:
    """A counter for one task; its states and memo end with it."""
    return Counter(read_model(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Null and empty texts have 0 bytes and 0 tokens. Rows are independent:
    repeated rows and ids give repeated rows, an empty table gives none, a
    null doc_id stays null, other columns aren't read. Long texts are counted
    in chunks of 65,536 characters whose maps are composed.
    """

    def make():
        counter = load(path)

        def work(batch: pa.RecordBatch):
            texts = batch.column("text").to_pylist()
            n = np.fromiter(map(counter.count, texts), np.int64, len(texts))
            size = np.fromiter((len(t.encode("utf-8")) for t in texts), np.int64, len(texts))
            yield {"doc_id": batch.column("doc_id"), "n_bytes": pa.array(size), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}

        return work

    return C.map_rows(C.texts(docs), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return count_tokens(C.documents(spark, sf_dir), P.path("piece_bpe_32k.model"))
