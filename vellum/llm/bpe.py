"""Counting byte-pair tokens with a matching automaton.

The vocabulary is compiled into an Aho-Corasick automaton. Reading a piece of text once, at each
position the longest vocabulary entry that ends there *and* may follow the last token of the prefix
before it is the last token of the exact encoding of the prefix; two tokens may stand side by side if
undoing their merges never finds a pair that byte-pair encoding would have merged across the border
first. Only counts are kept; no identifiers are produced.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import ahocorasick
import regex

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the pre-tokenising pattern this vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct pieces remembered by a worker before it starts afresh; a matter of memory, not of results.
REMEMBERED = 400_000


class _Counts(dict):
    """Piece to count, computed when first asked for."""

    def __init__(self, count):
        super().__init__()
        self._count = count

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self._count(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 64:
            self[piece] = n
        return n


class TokenCounter:
    def __init__(self, vocabulary: str, pattern: str = PATTERN):
        lines = Path(vocabulary).read_bytes().splitlines()
        self._rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
        self._bytes = {rank: token for token, rank in self._rank.items()}
        self._automaton = ahocorasick.Automaton()
        for token, rank in self._rank.items():
            self._automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self._automaton.make_automaton()
        self._halves: dict[int, tuple[int, int]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._find = regex.compile(pattern).findall
        self._counts = _Counts(self._count_piece)

    def _split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge made ``token``; a byte is its own halves."""
        known = self._halves.get(token)
        if known:
            return known
        data = self._bytes[token]
        found = (token, token)
        for i in range(1, len(data)):
            a, b = self._rank.get(data[:i]), self._rank.get(data[i:])
            if a is not None and b is not None and a < token and b < token and self._may_follow(a, b, token):
                found = (a, b)
                break
        self._halves[token] = found
        return found

    def _may_follow(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether encoding leaves a border between the two; merges from rank ``below`` on don't count."""
        limit = len(self._rank) if below is None else below
        a, b = left, right
        while True:
            merged = self._rank.get(self._bytes[a] + self._bytes[b])
            if merged is not None and merged < limit:
                return False
            whole_a, whole_b = len(self._bytes[a]) == 1, len(self._bytes[b]) == 1
            if whole_a and whole_b:
                return True
            if whole_b or (a > b and not whole_a):  # the later merge is undone first
                limit = min(limit, a)
                a = self._split(a)[1]
            else:
                limit = min(limit, b + 1)
                b = self._split(b)[0]

    def _count_piece(self, data: bytes) -> int:
        if data in self._rank:
            return 1
        n = len(data)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        done = 0  # the end whose token is settled; matches of an end come longest first
        fits = self._fits
        for at, (token, length) in self._automaton.iter(data.decode("latin-1")):
            end = at + 1
            if end == done:
                continue
            before = last[end - length]
            if end > length:
                if before < 0:
                    continue
                pair = (before, token)
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) > REMEMBERED:
                        fits.clear()
                    ok = fits[pair] = self._may_follow(before, token)
                if not ok:
                    continue
            last[end], count[end], done = token, count[end - length] + 1, end
        return count[n]

    def count(self, text: str | None) -> int | None:
        """Tokens of ``text``; null for null, 0 for empty."""
        if text is None:
            return None
        counts = self._counts
        return sum([counts[piece] for piece in self._find(text)])


@lru_cache(maxsize=4)
def counter(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> TokenCounter:
    """The counter of this process, compiled once."""
    return TokenCounter(f"{folder}/{vocabulary}")
