"""Hashes of words and shingles by numpy: one pass over a text's bytes, no loop over its words.

A word's hash is a polynomial in its bytes modulo 2^64, each byte standing for a random number; sums of the polynomial from
the text's start give all words at once. Shingle hashes mix those of their words in order.
"""

from __future__ import annotations

import re

import numpy as np

from memlift.llm.common import utf8

#: Longer texts are hashed in pieces of so many bytes, cut between words.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5
_STEP, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The same with A-Z standing for a-z.
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_A_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_power: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, n at least of each; kept for the next text."""
    if len(_power.get("up", ())) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            f = np.full(size, base, np.uint64)
            f[0] = 1
            _power[name] = np.multiply.accumulate(f)
    return _power["up"], _power["down"]


def _hash_joined(joined: bytes) -> np.ndarray:
    a = np.frombuffer(joined, np.uint8)
    up, down = _powers(len(a) + 1)
    sums = np.empty(len(a) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[a] * up[: len(a)], out=sums[1:])
    blank = np.flatnonzero(a == 32)
    start, end = np.empty(len(blank) + 1, np.int64), np.empty(len(blank) + 1, np.int64)
    start[0], end[-1] = 0, len(a)
    start[1:], end[:-1] = blank + 1, blank
    return (sums[end] - sums[start]) * down[start]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A hash of each word (words without blanks)."""
    joined = b" ".join(words)
    if len(joined) <= PIECE:
        return _hash_joined(joined) if words else np.empty(0, np.uint64)
    out, at = [], 0
    while at < len(joined):
        end = joined.find(b" ", at + PIECE)
        end = len(joined) if end < 0 else end
        out.append(_hash_joined(joined[at:end]))
        at = end + 1
    return np.concatenate(out)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words that follow each other."""
    n = len(h) - k + 1
    out = np.full(max(n, 0), k, np.uint64)
    for i in range(k):
        out ^= h[i : n + i]
        out *= _STEP
        out ^= out >> np.uint64(29)
    out *= _LAST
    out ^= out >> np.uint64(32)
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    if len(values) < 2:
        return values
    v = np.sort(values)
    return v[np.concatenate(([True], v[1:] != v[:-1]))]


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of k words, or of all words where they are fewer."""
    return distinct(mixed(h, min(k, len(h))).view(np.int64)) if len(h) else np.empty(0, np.int64)


def lower_words(text: str | None) -> list[bytes]:
    """Words between space and the characters 9 to 13, with A-Z in lower case."""
    return utf8(text).lower().split()


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """shingle_set() of each text; short texts are hashed together."""
    out: list[np.ndarray] = []
    held: list[list[bytes]] = []
    size = 0

    def flush() -> None:
        h = word_hashes([w for words in held for w in words])
        every = mixed(h, k).view(np.int64) if len(h) >= k else None
        at = 0
        for words in held:
            n = len(words)
            out.append(distinct(every[at : at + n - k + 1]) if n >= k else shingle_set(h[at : at + n], k))
            at += n
        held.clear()

    for text in texts:
        held.append(lower_words(text))
        size += len(text or "")
        if size > 1 << 17:
            flush()
            size = 0
    flush()
    return out


def spans_and_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash (in lower case) of each word of a text."""
    found, at = [], 0
    while at < len(raw):
        cut = _A_BLANK.search(raw, at + PIECE) if len(raw) - at > PIECE else None
        end = cut.start() if cut else len(raw)
        a = np.frombuffer(raw, np.uint8, end - at, at)
        blank = np.ones(len(a) + 2, bool)
        blank[1:-1] = _BLANK[a]
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        up, down = _powers(len(a) + 1)
        sums = np.empty(len(a) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_LOWER[a] * up[: len(a)], out=sums[1:])
        start, stop = edge[::2], edge[1::2]
        found.append((start + at, stop + at, (sums[stop] - sums[start]) * down[start]))
        at = end
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def sequence_hashes(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each sequence of words from first to end."""
    up, down = _powers(len(h) + 1)
    out, word = [], mixed(h, 1)
    for turn in (np.uint64(31), np.uint64(33)):
        word = (word ^ (word >> turn) ^ turn) * _LAST
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(word * up[: len(h)], out=sums[1:])
        x = (sums[end] - sums[first]) * down[first] ^ (end - first).astype(np.uint64) * _STEP
        x = (x ^ x >> np.uint64(29)) * _LAST
        out.append((x ^ x >> np.uint64(32)).view(np.int64))
    return out[0], out[1]
