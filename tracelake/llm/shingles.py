"""Hashed word shingles and their minima, vectorised over runs of texts."""

from __future__ import annotations

import re

import numpy as np

from .common import ASCII_LOWER

WORDS = 5

_rng = np.random.default_rng(20_000)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_NEXT = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes], step: int = 8 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text); words as in bytes.split after lower-casing A-Z."""
    data = b"\n".join([*texts, b""])
    ends = np.cumsum([len(t) + 1 for t in texts])
    hashes, starts, at = [], [], 0
    while at < len(data):  # a step at a time, each up to a space, so that a very long text takes no more memory
        end = at + step
        if end < len(data):
            space = _NEXT.search(data, end)
            end = space.end() if space else len(data)
        h, first = _words(np.frombuffer(data[at:end].translate(ASCII_LOWER), np.uint8))
        hashes.append(h)
        starts.append(first + at)
        at = end
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), ends), prepend=0)


def _words(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word; flat ends with a space."""
    space = _SPACE[flat]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    last = ~space
    last[:-1] &= space[1:]
    length = np.flatnonzero(last) - starts + 1
    inside = np.flatnonzero(~space)
    at = np.arange(len(inside)) - np.repeat(length.cumsum() - length, length)
    power = np.cumprod(np.full(int(length.max()), _STEP, np.uint64), dtype=np.uint64)
    value = _BYTE[flat[inside]] * power[at]
    return mix(np.add.reduceat(value, length.cumsum() - length) + length.astype(np.uint64)), starts


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, number of shingles of each text). A text of fewer words is one shingle; one of none has none."""
    h, n = word_hashes(texts)
    ends = n.cumsum()
    h = np.concatenate([h, np.zeros(words, np.uint64)])
    inside = np.repeat(ends, n)
    out = np.zeros(len(h) - words, np.uint64)
    at = np.arange(len(out))
    for k in range(words):
        out += np.where(at + k < inside, h[k : k + len(out)], np.uint64(0)) * _PLACE[k]
    whole = at + words <= inside
    short = np.zeros(len(out), bool)
    short[(ends - n)[(n > 0) & (n < words)]] = True
    good = whole | short
    return mix(out[good]), np.where(n >= words, n - words + 1, np.minimum(n, 1))


def minima(h: np.ndarray, n: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """(text, count) minima of the texts' shingle hashes under count permutations; n must have no zero."""
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    odd = rng.integers(0, 1 << 63, count, dtype=np.uint64) | np.uint64(1)
    starts = n.cumsum() - n
    out = np.empty((len(n), count), np.uint64)
    for k in range(count):
        v = (h ^ flip[k]) * odd[k]
        out[:, k] = np.minimum.reduceat(v ^ (v >> np.uint64(32)), starts)
    return out


def sets(h: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The sorted set of each text's shingles."""
    ends = n.cumsum()
    return [np.unique(h[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
