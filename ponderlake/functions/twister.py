"""Mersenne Twisters of many seeds at once, after Matsumoto and Nishimura (1998): the draws of Python's ``random`` by seed.

A column of the state belongs to a seed.  Draws name the places they are for, so seeds whose draws part ways (rejections, other
branches) stay in one array; a column is twisted when its 624 words are used up, and a place takes a new seed at any time.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np

#: Fixed values of the generator: words of a state, distance of the recurrence, its matrix, and the seeding's constants.
N, M = 624, 397
MATRIX = 0x9908B0DF
START, START_FACTOR = 19650218, 1812433253
FIRST_FACTOR, SECOND_FACTOR = 1664525, 1566083941
_U = np.uint32
#: Words of a long stream that are written together: about a quarter as many numbers.
STRETCH = 1 << 15


def _start() -> list[int]:
    words = [START]
    for i in range(1, N):
        words.append((START_FACTOR * (words[-1] ^ words[-1] >> 30) + i) & 0xFFFFFFFF)
    return words


_START = np.array(_start(), dtype=_U)


def _seeded(seeds: np.ndarray) -> np.ndarray:
    """States by key: a seed's 32-bit words, low first, without leading zeros."""
    n = len(seeds)
    low, high = (seeds & np.uint64(0xFFFFFFFF)).astype(_U), (seeds >> np.uint64(32)).astype(_U)
    # what odd steps add: the second word and its place, or the first word again where there is no second
    odd = np.where(high > 0, high + _U(1), low)
    mt = np.repeat(_START[:, None], n, axis=1)
    i = 1
    for k in range(N):
        before = mt[i - 1] ^ (mt[i - 1] >> _U(30))
        mt[i] = (mt[i] ^ (before * _U(FIRST_FACTOR))) + (odd if k % 2 else low)
        i += 1
        if i == N:
            mt[0], i = mt[N - 1], 1
    for _ in range(N - 1):
        before = mt[i - 1] ^ (mt[i - 1] >> _U(30))
        mt[i] = (mt[i] ^ (before * _U(SECOND_FACTOR))) - _U(i)
        i += 1
        if i == N:
            mt[0], i = mt[N - 1], 1
    mt[0] = 0x80000000
    return mt


def _twist(mt: np.ndarray) -> None:
    """The next 624 words in place; each stretch reads only words of the last round or of stretches before it."""
    for a, b in ((0, N - M), (N - M, 2 * (N - M)), (2 * (N - M), N - 1), (N - 1, N)):
        after = mt[a + 1 : b + 1] if b < N else mt[:1]
        y = (mt[a:b] & _U(0x80000000)) | (after & _U(0x7FFFFFFF))
        far = mt[a + M : b + M] if a == 0 else mt[a + M - N : b + M - N]
        mt[a:b] = far ^ (y >> _U(1)) ^ np.where(y & _U(1), _U(MATRIX), _U(0))


def _tempered(y: np.ndarray) -> np.ndarray:
    y = y ^ (y >> _U(11))
    y = y ^ ((y << _U(7)) & _U(0x9D2C5680))
    y = y ^ ((y << _U(15)) & _U(0xEFC60000))
    return y ^ (y >> _U(18))


class Twisters:
    """A generator for each place of a row of places; a negative seed is taken as its absolute value, as Python takes it."""

    def __init__(self, width: int):
        self.state = np.zeros((N, width), dtype=_U)
        self.ready = np.zeros((width, N), dtype=_U)
        self.at = np.full(width, N)

    def seed(self, who: np.ndarray, seeds: np.ndarray) -> None:
        self.state[:, who] = _seeded(np.abs(seeds.astype(np.int64)).astype(np.uint64))
        self.at[who] = N

    def words(self, who: np.ndarray) -> np.ndarray:
        """The next word of each place named; a place is named once."""
        at = self.at[who]
        used = who[at == N]
        if len(used):
            fresh = self.state[:, used]
            _twist(fresh)
            self.state[:, used] = fresh
            self.ready[used] = _tempered(fresh).T
            at = np.where(at == N, 0, at)
        self.at[who] = at + 1
        return self.ready[who, at]

    def unit(self, who: np.ndarray) -> np.ndarray:
        """Numbers of [0, 1) with 53 bits."""
        a, b = self.words(who) >> _U(5), self.words(who) >> _U(6)
        return (a.astype(np.float64) * 67108864.0 + b) / 9007199254740992.0

    def below(self, n: int, who: np.ndarray) -> np.ndarray:
        """Whole numbers below n (1 to 2^32 - 1): as many bits as n has, drawn again where they don't fit."""
        out, left = np.zeros(len(who), dtype=np.int64), np.arange(len(who))
        while len(left):
            x = (self.words(who[left]) >> _U(32 - n.bit_length())).astype(np.int64)
            out[left] = x
            left = left[x >= n]
        return out


def first_words(seeds: np.ndarray) -> np.ndarray:
    """The first N - M words of each seed, which rest on the seeded state alone: (words, seeds)."""
    mt = _seeded(np.abs(seeds.astype(np.int64)).astype(np.uint64))
    out = np.empty((N - M, len(seeds)), dtype=_U)
    for a in range(0, N - M, 8):  # few rows, so that they stay in the cache
        b = min(a + 8, N - M)
        y = (mt[a:b] & _U(0x80000000)) | (mt[a + 1 : b + 1] & _U(0x7FFFFFFF))
        out[a:b] = _tempered(mt[a + M : b + M] ^ (y >> _U(1)) ^ (y & _U(1)) * _U(MATRIX))
    return out


def _stretch_words(r: random.Random) -> np.ndarray:
    return np.frombuffer(r.getrandbits(32 * STRETCH).to_bytes(4 * STRETCH, "little"), dtype="<u4")


def stretches(seed: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Stretches that hold the numbers ``start`` to ``end`` (excluded) of ``longs``: place of the first number, state before it."""
    r, pos = random.Random(abs(seed)), 0
    while pos < end:
        state = r.getstate()[1]
        n = int(np.count_nonzero(_stretch_words(r)[1::2] < 1 << 31))
        if pos + n > start:
            yield pos, np.array(state, dtype="<u4").tobytes()
        pos += n


def stretch(state: bytes) -> np.ndarray:
    """The numbers of a stretch."""
    r = random.Random()
    r.setstate((3, tuple(np.frombuffer(state, dtype="<u4").tolist()), None))
    x = _stretch_words(r).astype(np.uint64)
    x = x[::2] | (x[1::2] << np.uint64(32))
    return x[x < np.uint64(1 << 63)].astype(np.int64)


def longs(seed: int):
    """Arrays of the numbers below 2^63 that follow from a seed, without end: two words each, again where they don't fit."""
    mt, blocks = _seeded(np.array([abs(seed)], dtype=np.uint64)), 1
    while True:
        words = []
        for _ in range(blocks):
            _twist(mt)
            words.append(_tempered(mt[:, 0]).astype(np.uint64))
        x = np.concatenate(words)  # an even number of words
        x = x[::2] | (x[1::2] << np.uint64(32))
        yield x[x < np.uint64(1 << 63)].astype(np.int64)
        blocks = min(2 * blocks, 128)


def first_longs(seeds: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` of ``longs`` of each seed, many seeds in lockstep: (seeds, n)."""
    mt = _seeded(np.abs(seeds.astype(np.int64)).astype(np.uint64))
    out, have = np.zeros((len(seeds), n), dtype=np.int64), np.zeros(len(seeds), dtype=np.int64)
    while (have < n).any():
        _twist(mt)
        words = _tempered(mt).T.astype(np.uint64)
        x = words[:, ::2] | (words[:, 1::2] << np.uint64(32))
        fits = x < np.uint64(1 << 63)
        at = have[:, None] + np.cumsum(fits, axis=1) - 1
        row, word = np.nonzero(fits & (at < n))
        out[row, at[row, word]] = x[row, word].astype(np.int64)
        have += fits.sum(axis=1)
    return out
