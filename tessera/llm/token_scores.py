"""Scores that add up over white-space tokens: each worker computes a token's row once and keeps it."""
from __future__ import annotations

from typing import Callable

import numpy as np

CACHE_TOKENS = 300_000
CACHE_CHARS = 8_000_000     # characters of the tokens in it
LONGEST = 200               # longer tokens are not kept


class TokenScores:
    """Token -> row of ``width`` floats, from ``score_new(list of tokens)``; a cache bounded in tokens and characters."""

    def __init__(self, width: int, score_new: Callable[[list[str]], np.ndarray], most: int = CACHE_TOKENS):
        self.width, self.score_new, self.most = width, score_new, most
        self.known: dict[str, int] = {}
        self.used = self.chars = 0
        self.rows = np.zeros((1024, width), np.float32)

    def __call__(self, tokens: list[str]) -> np.ndarray:
        """Rows of ``tokens``, in order."""
        new = set(tokens).difference(self.known)
        if self.used + len(new) > self.most or self.chars > CACHE_CHARS:
            self.known.clear()
            self.used = self.chars = 0
            new = set(tokens)
        fresh = sorted(new)
        if fresh:
            at = self.used
            if at + len(fresh) > len(self.rows):
                grown = np.zeros((max(at + len(fresh), 2 * len(self.rows)), self.width), np.float32)
                grown[:at] = self.rows[:at]
                self.rows = grown
            self.rows[at:at + len(fresh)] = self.score_new(fresh)
            self.known.update(zip(fresh, range(at, at + len(fresh))))
            self.used += len(fresh)
        found = self.rows[np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))]
        for t in fresh:
            if len(t) > LONGEST:
                del self.known[t]
            else:
                self.chars += len(t)
        return found


def code_points(words: list[str], before: str, after: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ``before + word + after`` joined; the word of each, and its offset in the word."""
    text = "".join([f"{before}{w}{after}" for w in words])
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + len(before) + len(after)
    word = np.repeat(np.arange(len(words)), sizes)
    offset = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return chars, word, offset
