"""Counts over one text that the quality operators share."""

from __future__ import annotations

import numpy as np

from .common import count_word_chars

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_BLANK = " \t\n\x0b\x0c\r"

# character classes: 0 blank, 1 lower or caseless letter, 2 upper letter, 3 digit, 4 symbol, 5 other
N_CLASSES = 6
_CLASS = np.ones(0x251, np.uint8)  # the last stands for all beyond
for _i in range(0x250):
    _c = chr(_i)
    if _c in _BLANK:
        _CLASS[_i] = 0
    elif _c in SYMBOLS:
        _CLASS[_i] = 4
    elif _c.isdigit():
        _CLASS[_i] = 3
    elif _c.isupper():
        _CLASS[_i] = 2
    elif not _c.isalpha():
        _CLASS[_i] = 5


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes(points: np.ndarray) -> np.ndarray:
    return _CLASS[np.minimum(points, len(_CLASS) - 1)]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` (a power of two) words found twice or more."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    # most texts repeat nothing: a sum of random word values, which windows that differ share
    # with a chance of 2**-64, shows it in one sort
    value = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    quick = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        quick = quick * np.uint64(0xD1342543DE82EF95) + value[k : n - window + 1 + k]
    quick.sort()
    if not (quick[1:] == quick[:-1]).any():
        return 0
    width = 1
    while width < window:  # names for all windows of twice the width
        pair = ids[:-width] * (int(ids.max()) + 1) + ids[width:]
        _, ids = np.unique(pair, return_inverse=True)
        width *= 2
    twice = np.bincount(ids)[ids] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str | None) -> dict[str, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(_BLANK):
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": count_word_chars(text),
        "n_symbols": sum(text.count(c) for c in SYMBOLS),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(words),
    }


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words
