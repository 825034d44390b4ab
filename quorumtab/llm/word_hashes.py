"""Hashes of all words of a block of texts at once, without a Python step for each word.

A word is a maximal run of bytes other than the six blanks. With a random number T[c] for each byte, an odd factor f and
S(i) the sum of T[c_j] f**j over the bytes before i, modulo 2**64, a word from s to e has the hash (S(e) - S(s)) f**-s,
finally mixed: it depends on the word alone and not on where it stands.
"""

from __future__ import annotations

import numpy as np

BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BYTES = [np.random.default_rng(7 + i).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for i in range(2)]
CHUNK = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of a factor and of its inverse, as many as the longest text so far has needed."""

    def __init__(self, factor: int) -> None:
        self.bases = (factor, pow(factor, -1, 1 << 64))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.tables[0]) < n:
            have = len(self.tables[0])
            self.tables = [np.concatenate([t, t * np.uint64(pow(b, have, 1 << 64))]) for t, b in zip(self.tables, self.bases)]
        return self.tables


POWERS = [Powers(f) for f in FACTORS]


def _of_block(data: np.ndarray, second: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where the words of some bytes start, and their hashes."""
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = BLANK[data]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends, out = edges[::2], edges[1::2], []
    for i in range(1 + second):
        power, inverse = POWERS[i].upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[i][data] * power[: len(data)], out=sums[1:])
        out.append(mixed((sums[ends] - sums[starts]) * inverse[starts]))
    return starts, out


def word_hashes(texts: list[bytes], second: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many words each text has, and the 64-bit hashes of all words in order; with second, further ones too."""
    counts, hashes, at = np.zeros(len(texts), np.int64), [[] for _ in range(1 + second)], 0
    while at < len(texts):
        end, n = at + 1, len(texts[at])
        while end < len(texts) and n + len(texts[end]) < CHUNK:
            n += len(texts[end]) + 1
            end += 1
        starts, got = _of_block(np.frombuffer(b" ".join(texts[at:end]), np.uint8), second)
        tops = np.cumsum([len(t) + 1 for t in texts[at:end]])
        counts[at:end] = np.diff(np.searchsorted(starts, tops), prepend=0)
        for all_, new in zip(hashes, got):
            all_.append(new)
        at = end
    return counts, [np.concatenate(h) if h else np.zeros(0, np.uint64) for h in hashes]
