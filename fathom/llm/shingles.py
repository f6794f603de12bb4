"""Vectorised hashes of words and word n-grams over UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MASK = (1 << 64) - 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20
#: Bytes that end a word: space and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 ** 64. Texts are hashed in pieces, so n has a bound."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs without white space."""
    word = np.concatenate([[False], ~_SPACE[data], [False]])
    turn = np.flatnonzero(word[1:] != word[:-1])
    return turn[::2], turn[1::2]


def word_hashes(text: bytes, piece: int = PIECE) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z in lower case, in order.

    A word's hash is a polynomial of its bytes, so that of a word which is cut by the end of a piece is put together.
    """
    found, held, size = [], 0, 0
    for at in range(0, len(text), piece):
        data = _LOWER[np.frombuffer(text, np.uint8, min(piece, len(text) - at), at)]
        a, b = word_bounds(data)
        if size and (not len(a) or a[0] > 0):
            found.append(_closed(np.array([held], np.uint64), np.array([size])))
            held = size = 0
        if not len(a):
            continue
        up, down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            own = (sums[b] - sums[a]) * down[a]
        sizes = b - a
        if size:
            own[0] = (held + int(own[0]) * pow(int(_BASE), size, 1 << 64)) & _MASK
            sizes[0] += size
            held = size = 0
        if b[-1] == len(data) and at + piece < len(text):
            held, size, own, sizes = int(own[-1]), int(sizes[-1]), own[:-1], sizes[:-1]
        found.append(_closed(own, sizes))
    if size:
        found.append(_closed(np.array([held], np.uint64), np.array([size])))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _closed(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(sums + sizes.astype(np.uint64))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    count = len(words) - n + 1
    with np.errstate(over="ignore"):
        h = np.zeros(count, np.uint64)
        for i in range(n):
            h = mix(h + words[i : i + count])
    return h


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """The distinct n-word shingles of a text as sorted hashes."""
    return np.unique(ngram_hashes(word_hashes(text), n))
