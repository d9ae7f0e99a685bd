"""Byte-level BPE encoding and decoding with a published vocabulary (never trained here)."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import _common as C
from lodestrata.llm.bpe_fst import BpeFst

#: White space as the splitting pattern's engine knows it.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_AFTER_SPACE = re.compile(f"[{SPACES}] ")
_CUT = re.compile(f"(?<=[^{SPACES}]) ")


def read_ranks(path: str) -> dict[str, int]:
    """A rank file's tokens (bytes as Latin-1) and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}


class Utf8Machine:
    """Incremental UTF-8 reader over tokens: what is complete is decoded, a begun character waits.

    ``states``: bytes still due of a character, with the range its next byte
    must lie in. Bytes that can't be UTF-8 become U+FFFD in the text; the
    bytes themselves are kept by ``feed`` as they are.
    """

    def __init__(self, table: list[bytes]):
        self.table = table
        #: tokens after which no character is open if none was open before
        self.closed = np.array([self.due(b"", t) == 0 for t in table], bool)
        self.rest = b""

    @staticmethod
    def due(rest: bytes, token: bytes) -> int:
        """How many trailing bytes of rest + token belong to a character that isn't complete yet."""
        due = size = 0
        low, high = 0x80, 0xBF
        for b in rest + token:
            if due and low <= b <= high:
                due, size, low, high = due - 1, size + 1, 0x80, 0xBF
                continue
            low, high, size = 0x80, 0xBF, 1
            due = 1 if 0xC2 <= b <= 0xDF else 2 if 0xE0 <= b <= 0xEF else 3 if 0xF0 <= b <= 0xF4 else 0
            if b == 0xE0:
                low = 0xA0
            elif b == 0xED:
                high = 0x9F
            elif b == 0xF0:
                low = 0x90
            elif b == 0xF4:
                high = 0x8F
        return size if due else 0

    def feed(self, ids: np.ndarray) -> tuple[bytes, str]:
        """The next tokens' bytes, and the text that is complete with them."""
        raw = b"".join(map(self.table.__getitem__, ids.tolist()))
        whole = self.rest + raw
        tail = 0 if not len(ids) or (not self.rest and self.closed[ids].all()) else self.due(b"", whole[-4:] if len(whole) > 4 else whole)
        cut = len(whole) - tail
        self.rest = whole[cut:]
        return raw, whole[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        text, self.rest = self.rest.decode("utf-8", "replace"), b""
        return text


class ByteBpe:
    """Encoder and decoder of one rank file.

    A text is cut at each space behind something that isn't white space: the
    pattern never matches across such a place, so each field is encoded by
    itself and what came out is kept (up to ``memo`` fields).
    """

    def __init__(self, ranks: dict[str, int], pattern: str, memo: int = 600_000):
        self.ranks = ranks
        self.fst = BpeFst(ranks, max_states=250_000)
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))
        self.memo = C.Recent(lambda word: self._field(" " + word), memo)
        self.table: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.table[r] = t.encode("latin-1")

    def _field(self, field: str) -> bytes:
        ranks, encode = self.ranks, self.fst.encode
        ids = [ranks[t] for piece in self.pattern.findall(field) for t in encode(piece if piece.isascii() else piece.encode("utf-8").decode("latin-1"))]
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = _CUT.split(text) if _SPACE_AFTER_SPACE.search(text) else text.split(" ")
        get, miss = self.memo.new.get, self.memo.miss
        out = [self._field(words[0])] if words[0] else []
        out += [get(w) or miss(w) for w in words[1:]]
        return b"".join(out)

    def decode(self, ids: bytes, step: int = 1 << 16) -> Iterator[tuple[bytes, str]]:
        """Bytes and text, ``step`` tokens at a time."""
        machine = Utf8Machine.__new__(Utf8Machine)
        machine.table, machine.closed, machine.rest = self.table, self._closed(), b""
        every = np.frombuffer(ids, "<u4")
        for i in range(0, len(every), step):
            yield machine.feed(every[i : i + step])
        if machine.rest:
            yield b"", machine.end()

    def _closed(self) -> np.ndarray:
        if not hasattr(self, "closed"):
            self.closed = Utf8Machine(self.table).closed
        return self.closed


def load(path: str, pattern: str) -> ByteBpe:
    """An encoder for one task. Its states and memo end with the task: a Python worker that waits or does other work holds nothing."""
    return ByteBpe(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, decoded_ok; with ``keep_ids`` also ids (binary, little-endian u32) and decoded text.

    Null and empty texts have no tokens and the hash of nothing. Rows are
    independent: repeated rows and ids give repeated rows, an empty table
    gives none, a null doc_id stays null, other columns aren't read. Texts of
    any length are encoded in one pass and decoded in steps of 65,536 tokens.
    """

    def make():
        bpe = load(path, pattern)

        def work(batch: pa.RecordBatch):
            n, a, b, ok, ids_out, text_out = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text)
                sha, same = hashlib.sha256(), []
                for raw, part in bpe.decode(ids):
                    sha.update(raw)
                    same.append(part)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(sha.hexdigest())
                decoded = "".join(same)
                ok.append(decoded == text)
                if keep_ids:
                    ids_out.append(ids)
                    text_out.append(decoded)
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string()), "decoded_ok": pa.array(ok, pa.bool_())}
            if keep_ids:
                out |= {"ids": pa.array(ids_out, pa.binary()), "decoded": pa.array(text_out, pa.string())}
            yield out

        return work

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_ok boolean"
    return C.map_rows(C.texts(docs), schema + ", ids binary, decoded string" * keep_ids, make)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode_documents(C.documents(spark, sf_dir), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
