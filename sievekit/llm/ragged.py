"""Ragged integer arrays and bounded stores of words, for tasks that look many words up at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Ragged:
    """Integer arrays of different lengths, kept by number in one growing array."""

    def __init__(self, dtype: type = np.int32):
        self.flat, self.used = np.zeros(1 << 12, dtype), 0
        self.starts, self.sizes = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32)

    def put(self, rows: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> None:
        """Keep the arrays that ``values`` joins under the numbers ``rows``, new ones in any order."""
        if not len(rows):
            return
        end, most = self.used + len(values), int(rows.max()) + 1
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(end, 2 * self.used) - self.used, self.flat.dtype)])
        if most > len(self.starts):
            more = max(most, 2 * len(self.starts)) - len(self.starts)
            self.starts, self.sizes = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.starts, self.sizes))
        self.flat[self.used : end] = values
        self.starts[rows] = np.cumsum(lengths) - lengths + self.used
        self.sizes[rows] = lengths
        self.used = end

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of ``rows`` joined, and their lengths."""
        lengths = self.sizes[rows].astype(np.int64)
        places = np.repeat(self.starts[rows] - np.cumsum(lengths) + lengths, lengths)
        places += np.arange(len(places))
        return self.flat[places], lengths


class _Index(dict):
    """Numbers what it is asked for; ``new`` are the words that came last."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordStore:
    """Numbers words. ``add`` gets the new words, distinct, and their numbers, and computes what is kept of them; it may number more.

    The store is emptied before a look-up once it holds ``most`` words or ``most_chars`` characters, so beyond the
    words of one look-up its size is bounded by both.
    """

    def __init__(self, add: Callable[[list[str], np.ndarray], None], clear: Callable[[], None], most: int, most_chars: int):
        self.add, self.clear, self.most, self.most_chars = add, clear, most, most_chars
        self.index, self.chars = _Index(), 0

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) >= self.most or self.chars >= self.most_chars:
            self.index, self.chars = _Index(), 0
            self.clear()
        found = self.numbers(words)
        if new := self.index.new:
            self.index.new = []
            self.add(new, np.arange(len(self.index) - len(new), len(self.index)))
            self.chars += sum(map(len, new)) + sum(map(len, self.index.new))
            self.index.new = []
        return found

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def parts_of(items: list, sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring items whose sizes sum up to about ``most``: a large item stands alone."""
    out, begin, sum_ = [], 0, 0
    for k in range(len(items)):
        if k > begin and sum_ + sizes[k] > most:
            out.append((begin, k))
            begin, sum_ = k, 0
        sum_ += sizes[k]
    return [*out, (begin, len(items))] if items else []
