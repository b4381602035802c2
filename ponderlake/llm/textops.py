"""Vectorised text kernel shared by the corpus operators.

A block of texts is one flat UTF-8 byte array with document offsets.  Words are
maximal runs of bytes that are not one of the six ASCII white-space bytes
(0x20, 0x09-0x0D), which is the same as ``[^\\x20\\x09-\\x0D]+`` on the decoded
text because those bytes never occur inside a multi-byte character.  All hashes
are 64-bit and depend on the content only, never on the block, the process or
the machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed at a time: temporaries stay within a few MB.
CHUNK = 1 << 19
#: Bytes of text in a block: about ten times as much memory is used for it.
BLOCK = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], U64))[0])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base | 1, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOW, _HIGH = _powers(0x9E3779B97F4A7C15, 1 << 12), _powers(0xD6E8FEB86659FD93, 1 << 12)
_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
_PLAIN = np.where(WHITE, U64(0), _BYTES)
_FOLDED = np.where(WHITE, U64(0), _BYTES[LOWER])


class Block:
    """Documents' bytes, offsets of documents, and their words.

    ``start``/``end``: byte range of each word; ``first``: index of each
    document's first word, with one more entry at the end.
    """

    __slots__ = ("data", "end", "first", "fold", "n", "off", "start")

    def __init__(self, data: np.ndarray, off: np.ndarray, fold: bool = False):
        self.data, self.off, self.fold, self.n = data, off.astype(np.int64), fold, len(off) - 1
        white = WHITE[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:] = False
        if len(data):
            edge[1:-1] = white[:-1]
            edge[-1] = True
            edge[self.off[self.off < len(data)]] = True
            begins = edge[:-1] & ~white
            edge[:-1] = white
            edge[self.off] = True
            ends = edge[1:] & ~white
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.off)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word (of its lower-case form if ``fold``)."""
        out, table, n = np.empty(len(self.start), U64), _FOLDED if self.fold else _PLAIN, len(self.start)
        a = 0
        while a < n:
            b = int(np.searchsorted(self.start, self.start[a] + CHUNK))
            s = self.start[a:b] - self.start[a]
            part = self.data[self.start[a] : self.end[b - 1]]
            at = np.arange(len(part), dtype=np.int32)
            at -= np.repeat(s.astype(np.int32), np.diff(np.append(s, len(part))))
            long = int((self.end[a:b] - self.start[a:b]).max())
            value = table[part]
            if long <= len(_LOW):
                np.clip(at, 0, len(_LOW) - 1, out=at)  # only white space after a word lies beyond
                value *= _LOW[at]
            else:
                value *= _LOW[at & 0xFFF] * _HIGH[(at >> 12) & 0xFFF]
                value += ((at >> 24) > 0) * (at >> 24).astype(U64) * table[part] * U64(0x632BE59BD9B4E019)
            out[a:b] = np.add.reduceat(value, s)
            a = b
        return mix(out + (self.end - self.start).astype(U64) * U64(0x8CB92BA72F3D8DD7))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def valid(self, k: int) -> np.ndarray:
        """Whether a window of k words of one document starts at each word."""
        ok = np.ones(len(self.start), bool)
        last = self.first[1:]
        for j in range(1, k):
            at = last - j
            ok[at[(at >= self.first[:-1])]] = False
        return ok


def windows(h: np.ndarray, k: int, seed: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """Hash of the k values from each place on (places past the end wrap: mask them).

    Built by doubling: a window of 2n values is one of n values and the next.
    """
    q = seed | 1
    have, size = h, 1
    out, got, shift = None, 0, 1
    power = q
    bits = k
    while bits:
        if bits & 1:
            if out is None:
                out, got = have, size
            else:
                out = out * U64(power) + np.roll(have, -got)
                got += size
        bits >>= 1
        if bits:
            have = have * U64(power) + np.roll(have, -size)
            size *= 2
            power = power * power & 0xFFFFFFFFFFFFFFFF
            shift += 1
    return mix(out ^ U64(k * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF))


def per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of a word-wise array over each document."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def strings(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def blocks(
    batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut so that each holds about ``size`` bytes of text, or one longer text."""
    for batch in batches:
        data, off = strings(batch.column(text))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
            yield batch.slice(a, b - a), data[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b
