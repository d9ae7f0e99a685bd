"""Byte-pair merges compiled into a lazily determinised finite-state transducer.

A token sequence is what BPE gives for a string exactly if every two
neighbours in it are: ``bpe(a + b) == [a, b]``. So every prefix of the input
has one valid segmentation, and a nondeterministic transducer that reads
symbols, walks the vocabulary's trie and starts a new token only behind a
compatible one has a single successful run for any input. ``BpeFst`` does the
subset construction on demand. A deterministic state is the set of runs still
possible: each the token it stands behind, what it has read of the next one,
and by how much its token count exceeds the least. A transition carries

* the token that ends at this symbol, if one does: ``encode`` emits tokens as
  soon as one run is left, at most the longest token's length later;
* by how much the least count grows: ``count`` adds these up.

Symbols are characters: for byte-level vocabularies the bytes as Latin-1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping


def merge_by_rank(symbols: Iterable[str], rank: Mapping[str, int]) -> list[str]:
    """Plain BPE: join the neighbours of least rank, leftmost first, until none is left."""
    parts = list(symbols)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = rank.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class _State(dict):
    """Next state by symbol. ``gain``: what entering adds to the count; ``ends``: the token that ends here, "" if none; ``rest``: what ending here adds; ``flush``: whether a token ends here in the only run left."""

    __slots__ = ("runs", "gain", "ends", "rest", "flush")


class BpeFst:
    """``rank``: token to rank. Symbols outside the vocabulary stand as tokens of their own; ``weight`` says what a token counts."""

    def __init__(self, rank: Mapping[str, int], weight: Callable[[str], int] | None = None, max_states: int = 150_000):
        self.rank = rank
        self.weight = weight or (lambda token: 1)
        self.max_states = max_states
        self.inner = {t[:i] for t in rank for i in range(1, len(t))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget the states made so far; they are made again when met."""
        self.states: dict[tuple, _State] = {}
        self.start = self._state((("", "", 0),), 0, "", 0)

    def _state(self, runs: tuple, gain: int, ends: str, rest: int) -> _State:
        key = (runs, gain, ends)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = _State()
            found.runs, found.gain, found.ends, found.rest, found.flush = runs, gain, ends, rest, len(runs) == 1 and ends != ""
        return found

    def compatible(self, a: str, b: str) -> bool:
        """Can token b stand behind token a ("" at the start)?"""
        key = (a, b)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            got = self.pairs[key] = merge_by_rank(a + b, self.rank) == ([a, b] if a else [b])
        return got

    def step(self, state: _State, c: str) -> _State:
        rank, inner = self.rank, self.inner
        runs, ends, least = [], "", None
        for behind, read, more in state.runs:
            word = read + c
            if not ends and (word in rank or not read) and self.compatible(behind, word):
                ends, cost = word, more + self.weight(word)
            if word in inner:
                runs.append((behind, word, more))
                least = more if least is None or more < least else least
        if ends:
            runs.append((ends, "", cost))
            least = cost if least is None or cost < least else least
        if not runs:
            raise ValueError("the vocabulary has tokens that merges can't reach")
        if least:
            runs = [(a, b, n - least) for a, b, n in runs]
        if len(self.states) >= self.max_states:
            self.reset()
        to = state[c] = self._state(tuple(runs), least, ends, runs[-1][2] if ends else 0)
        return to

    def count(self, symbols: str) -> int:
        """Summed weight of the tokens of ``symbols``."""
        state, n = self.start, 0
        for c in symbols:
            to = state.get(c)
            state = to if to is not None else self.step(state, c)
            n += state.gain
        return n + state.rest

    def encode(self, symbols: str) -> list[str]:
        state, out, ends, base = self.start, [], [], 0
        for c in symbols:
            to = state.get(c)
            state = to if to is not None else self.step(state, c)
            ends.append(state.ends)
            if state.flush:
                if len(ends) == len(state.ends):  # one token since the last flush
                    out.append(state.ends)
                else:
                    out += _back(ends)
                ends.clear()
        if ends:
            out += _back(ends)
        return out


def _back(ends: list[str]) -> list[str]:
    """The one chain of tokens that ends at the last symbol. ends[i]: the token that ends at symbol i."""
    i, out = len(ends), []
    while i > 0:
        t = ends[i - 1]
        out.append(t)
        i -= len(t)
    out.reverse()
    return out
