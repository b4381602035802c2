"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file (a public vocabulary, its path a parameter) is read with the
sentencepiece library for its pieces and scores only; encoding and decoding are
done here.  Supported: BPE models with identity normalisation, a dummy prefix,
kept white space and byte fallback; others raise.

Encoding.  A text becomes ``_`` + text with spaces as ``_`` (U+2581) and is cut
into segments that no piece spans: before a ``_`` that follows another
character, and around line feeds.  Distinct segments of a block, unless cached,
are laid out as one flat array of symbols.  In every round the best pair score
of each segment is found (segmented minimum), and its leftmost pair is merged in
all segments at once; if no pair with the merged piece can score as well or
better, all its non-overlapping occurrences are merged.  Arrays are compacted
after each round and finished segments leave, until no pair remains.  Symbols
without a piece become their UTF-8 bytes.

Decoding.  Piece bytes are gathered flat for all ids of a block; ``_`` becomes a
space, the first one is dropped, and runs of byte pieces are decoded as UTF-8
with U+FFFD for what is invalid.

What segments rest on is verified when a model is read: that no piece spans two of
them, and that long runs of spaces fall into whole pieces of spaces from the left.
Other models raise.

Defined results: null and empty texts have no ids and decode to the empty text;
documents of any length are encoded whole; ties in score take the leftmost pair,
as the library does; repeated rows are encoded each, null ids kept; an empty table
gives an empty result; columns besides id, text and those named to carry are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .textops import blocks

SPACE = "▁"
#: Segments kept per process; about 100 bytes each.
CACHE = 400_000


class Pieces:
    """The vocabulary as arrays, and encoding and decoding with them."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        if lib.encode(" a  b ", out_type=str) and lib.decode(lib.encode(" a①  b ")) != " a①  b ":
            raise ValueError("only models with identity normalisation and byte fallback are supported")
        n = lib.vocab_size()
        self.names = [lib.id_to_piece(i) for i in range(n)]
        self.byte_id = np.zeros(256, np.int32)
        special = np.zeros(n, bool)
        self.byte_of = np.full(n, -1, np.int16)
        for i, x in enumerate(self.names):
            if lib.is_byte(i):
                self.byte_id[int(x[3:5], 16)] = i
                self.byte_of[i] = int(x[3:5], 16)
            special[i] = lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)
        self.id_of = {x: i for i, x in enumerate(self.names) if not special[i]}
        spanning = [x for x in self.id_of if "\n" in x and len(x) > 1 or SPACE in x.lstrip(SPACE)]
        if spanning:
            raise ValueError(f"pieces that span segments aren't supported: {spanning[:5]}")
        #: The longest piece of spaces; longer runs are cut into such pieces.
        self.run = max([len(x) for x in self.id_of if not x.strip(SPACE)], default=1)
        for k in range(2 * self.run + 1, 5 * self.run + 2):
            for tail in ("", "a"):
                got = [len(x) - len(x.lstrip(SPACE)) for x in lib.encode(" " * (k - 1) + tail, out_type=str)]
                if got[: (k - self.run - 1) // self.run] != [self.run] * ((k - self.run - 1) // self.run):
                    raise ValueError("only models that merge runs of spaces from the left are supported")
        scores = np.array([lib.get_score(i) for i in range(n)])
        # equal scores share a rank: the leftmost of them is merged first
        _, rank = np.unique(-scores, return_inverse=True)
        self.rank = rank.astype(np.int64)
        # every way to make a piece from two: left symbol, right symbol -> piece; symbols are ids, or n + code point
        self.n = n
        left, right, made = [], [], []
        for x, i in self.id_of.items():
            for k in range(1, len(x)):
                a, b = self._symbol(x[:k]), self._symbol(x[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i)
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        made_ = np.array(made, np.int64)
        order = np.argsort(key)
        self._build(key[order], made_[order])
        safe = np.ones(n, bool)
        side = np.concatenate([np.array(left), np.array(right)])
        made2 = np.concatenate([made_, made_])
        known = side < n
        worse = self.rank[made2[known]] <= self.rank[side[known]]
        safe[side[known][worse]] = False
        self.safe = safe
        raw = [
            bytes([self.byte_of[i]])
            if self.byte_of[i] >= 0
            else b""
            if special[i]
            else x.replace(SPACE, " ").encode()
            for i,
            x in enumerate(self.names)
        ]
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_len)])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        digits = [str(i).encode() + b"," for i in range(n)]
        self.digit_len = np.array([len(x) for x in digits], np.int64)
        self.digit_at = np.concatenate([[0], np.cumsum(self.digit_len)])
        self.digit = np.frombuffer(b"".join(digits), np.uint8)
        self.cache: dict[str, int] = {}
        self._reset()

    def _symbol(self, x: str) -> int | None:
        """A piece's id; a single character without one is a symbol too."""
        if x in self.id_of:
            return self.id_of[x]
        return self.n + ord(x) if len(x) == 1 else None

    def _build(self, key: np.ndarray, made: np.ndarray) -> None:
        """Open-addressing table of pairs, so that lookups are a few gathers."""
        bits = max(10, int(np.ceil(np.log2(max(1, len(key)) * 3))))
        self.shift = np.uint64(64 - bits)
        self.slots = np.full((1 << bits) + 64, -1, np.int64)
        self.makes = np.full((1 << bits) + 64, -1, np.int64)
        at = self._slot(key)
        left = np.arange(len(key))
        while len(left):
            free = self.slots[at[left]] < 0
            first = np.unique(at[left[free]], return_index=True)[1]
            put = left[free][first]
            self.slots[at[put]], self.makes[at[put]] = key[put], made[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] += 1
        self.probes = int(
            (np.arange(len(self.slots))[self.slots >= 0] - self._slot(self.slots[self.slots >= 0])).max(initial=0)
        ) + 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece made of two neighbouring symbols, or -1."""
        key = a << 32 | b
        at = self._slot(key)
        out = np.where(self.slots[at] == key, self.makes[at], -1)
        open_ = np.flatnonzero((self.slots[at] != key) & (self.slots[at] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] += 1
            hit = self.slots[at[open_]]
            out[open_] = np.where(hit == key[open_], self.makes[at[open_]], out[open_])
            open_ = open_[(hit != key[open_]) & (hit >= 0)]
        return out

    def _reset(self) -> None:
        self.cache.clear()
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.begin = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def merge(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each segment: flat ids and their number per segment."""
        text = "".join(segments)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        u = np.unique(points)
        ids = np.array([self.id_of.get(chr(c), -1) for c in u.tolist()], np.int64)
        sym = ids[np.searchsorted(u, points)]
        sym = np.where(sym < 0, self.n + points, sym)
        count = np.array([len(x) for x in segments], np.int64)
        seg = np.repeat(np.arange(len(segments)), count)
        done_sym, done_seg = [], []
        made = self._pair(sym[:-1], sym[1:])
        made = np.append(np.where(seg[:-1] == seg[1:], made, -1), -1)
        big = np.int64(1) << 40
        while len(sym):
            rank = np.where(made >= 0, self.rank[made], big)
            heads = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            size = np.diff(np.append(heads, len(sym)))
            least = np.minimum.reduceat(rank, heads)
            over = least == big
            if over.any():
                gone = np.repeat(over, size)
                done_sym.append(sym[gone]), done_seg.append(seg[gone])
                keep = ~gone
                sym, seg, made, rank = sym[keep], seg[keep], made[keep], rank[keep]
                if not len(sym):
                    break
                least, size = least[~over], size[~over]
                heads = np.concatenate([[0], np.cumsum(size)[:-1]])
            hit = np.flatnonzero(rank == np.repeat(least, size))
            owner = seg[hit]
            lead = np.append(True, owner[1:] != owner[:-1])
            first = np.maximum.accumulate(np.where(lead, np.arange(len(hit)), 0))
            # further occurrences of the leftmost piece, if it is safe and they don't touch
            same = (made[hit] == made[hit[first]]) & self.safe[made[hit]]
            near = np.append(False, (hit[1:] - hit[:-1] == 1) & ~lead[1:])
            if (near & same).any():
                run = np.arange(len(hit)) - np.maximum.accumulate(np.where(near, 0, np.arange(len(hit))))
                take = lead | (same & (run % 2 == 0))
            else:
                take = lead | same
            at = hit[take]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            to = np.cumsum(keep) - 1
            sym, seg, made, at = sym[keep], seg[keep], made[keep], to[at]
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            near_ = np.flatnonzero(touched)
            nxt = np.minimum(near_ + 1, len(sym) - 1)
            ok = (nxt > near_) & (seg[near_] == seg[nxt])
            made[near_] = np.where(ok, self._pair(sym[near_], sym[nxt]), -1)
        sym, seg = np.concatenate(
            done_sym or [np.zeros(0, np.int64)]
        ), np.concatenate(done_seg or [np.zeros(0, np.int64)])
        order = np.argsort(seg, kind="stable")
        sym, seg = sym[order], seg[order]
        return self._fallback(sym, seg, len(segments))

    def _fallback(self, sym: np.ndarray, seg: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece become the ids of their bytes."""
        bare = np.flatnonzero(sym >= self.n)
        if len(bare):
            parts = [chr(c).encode() for c in (sym[bare] - self.n).tolist()]
            times = np.ones(len(sym), np.int64)
            times[bare] = [len(x) for x in parts]
            out = np.repeat(sym, times)
            seg = np.repeat(seg, times)
            out[out >= self.n] = self.byte_id[np.frombuffer(b"".join(parts), np.uint8)]
            sym = out
        return sym.astype(np.int32), np.bincount(seg, minlength=n)

    def _learn(self, segments: list[str]) -> None:
        ids, count = self.merge(segments)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        n = len(self.cache)
        while n + len(segments) > len(self.begin):
            self.begin, self.length = np.concatenate([self.begin, self.begin * 0]), np.concatenate(
                [self.length, self.length * 0]
            )
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[n : n + len(segments)] = self.used + np.concatenate([[0], np.cumsum(count)[:-1]])
        self.length[n : n + len(segments)] = count
        self.used += len(ids)
        self.cache.update(zip(segments, range(n, n + len(segments)), strict=True))

    def _cut(self, text: str) -> list[str]:
        """Segments of ``_text`` in order: line feeds alone, else ``_`` runs with what follows."""
        plain = text.replace(SPACE, " ")
        if not plain:
            return []
        if "  " not in plain and " \n" not in plain and plain[0] != " " and plain[-1] != " ":
            out = []
            for i, line in enumerate(plain.split("\n")):
                if i:
                    out.append("\n")
                    if not line:
                        continue
                    if line[0] != " ":
                        first, _, rest = line.partition(" ")
                        out.append(first)
                        if not rest:
                            continue
                        line = rest
                    else:
                        line = line[1:]
                out.extend([SPACE + w for w in line.split(" ")])
            return out
        out, marked = [], SPACE + plain.replace(" ", SPACE)
        for i, line in enumerate(marked.split("\n")):
            if i:
                out.append("\n")
            parts = line.split(SPACE)
            run = 0
            if parts[0]:
                out.append(parts[0])
            for w in parts[1:]:
                run += 1
                if w:
                    while run > 2 * self.run:  # a full piece of spaces merges with nothing more
                        out.append(SPACE * self.run)
                        run -= self.run
                    out.append(SPACE * run + w)
                    run = 0
            while run > 2 * self.run:
                out.append(SPACE * self.run)
                run -= self.run
            if run:
                out.append(SPACE * run)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the number of each text's ids."""
        cut = [self._cut(x) for x in texts]
        if len(self.cache) > CACHE:
            self._reset()
        flat = [w for x in cut for w in x]
        at = np.fromiter(map(self.cache.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            missing = [flat[i] for i in new]
            self._learn(list(dict.fromkeys(missing)))
            at[new] = np.fromiter(map(self.cache.__getitem__, missing), np.int64, len(missing))
        size = self.length[at]
        words = np.array([len(x) for x in cut], np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[ragged(self.begin[at], size)]
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(words)])])

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """UTF-8 of each list of ids."""
        ids = ids.astype(np.int64)
        data = self.raw[ragged(self.raw_at[ids], self.raw_len[ids])]
        ends = np.concatenate([[0], np.cumsum(self.raw_len[ids])])
        to = np.concatenate([[0], np.cumsum(count)])
        off = ends[to]
        raw = data.tobytes()
        out = []
        for i in range(len(count)):
            x = raw[off[i] : off[i + 1]]
            if count[i] and self.byte_of[ids[to[i]]] < 0 and x[:1] == b" ":
                x = x[1:]
            try:
                x.decode()
            except UnicodeDecodeError:
                x = self._mend(ids[to[i] : to[i + 1]])
            out.append(x)
        return out

    def _mend(self, ids: np.ndarray) -> bytes:
        """Byte pieces that aren't UTF-8: each invalid byte becomes U+FFFD."""
        out, run = [], b""
        for j, i in enumerate([*ids.tolist(), None]):
            if i is not None and self.byte_of[i] >= 0:
                run += bytes([self.byte_of[i]])
                continue
            while run:
                for k in (1, 2, 3, 4):
                    try:
                        out.append(run[:k].decode().encode())
                        run = run[k:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�".encode())
                    run = run[1:]
            if i is not None:
                x = self.raw[self.raw_at[i] : self.raw_at[i + 1]].tobytes()
                out.append(x[1:] if not j and x[:1] == b" " else x)
        return b"".join(out)

    def listed(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """Decimal ids joined by commas, for each list."""
        ids = ids.astype(np.int64)
        raw = self.digit[ragged(self.digit_at[ids], self.digit_len[ids])].tobytes()
        off = np.concatenate([[0], np.cumsum(self.digit_len[ids])])[np.concatenate([[0], np.cumsum(count)])]
        return [raw[off[i] : max(off[i], off[i + 1] - 1)] for i in range(len(count))]


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices begin[i], begin[i] + 1, ... for size[i] places each, one after another."""
    total = int(size.sum())
    out = np.ones(total, np.int64)
    some = size > 0
    b, s = begin[some], size[some]
    if not total:
        return out
    out[0] = b[0]
    at = np.cumsum(s)[:-1]
    out[at] = b[1:] - (b[:-1] + s[:-1] - 1)
    return np.cumsum(out, out=out)


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _texts(data: np.ndarray, off: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids`` (array of int), one row per document."""
    shared.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for rows, data, off in blocks(batches, size=1 << 20):
            ids, count = model.encode(_texts(data, off))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids)
                    )
                ],
                names=["doc_id", "ids"]
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    ).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and ``text`` of a table with doc_id and ``ids`` (null: no ids)."""
    shared.prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for rows in batches:
            col = rows.column("ids")
            count = np.diff(np.asarray(col.offsets)) if not col.null_count else np.array(
                [0 if x is None else len(x) for x in col.to_pylist()]
            )
            ids = np.asarray(col.flatten())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([x.decode() for x in model.decode(ids, count)], pa.string())],
                names=["doc_id", "text"]
            )

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids")).mapInArrow(run, "doc_id long, text string")


def tokenise(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Columns ``keep``, n_tokens, ids and decoded_sha256 of every row: what training reads, and a digest to check it by."""
    shared.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for rows, data, off in blocks(batches, text="__text", size=1 << 20):
            ids, count = model.encode(_texts(data, off))
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids)
            )
            sha = pa.array([hashlib.sha256(x).hexdigest() for x in model.decode(ids, count)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in keep), pa.array(count, pa.int64()), lists, sha],
                names=[*keep, "n_tokens", "ids", "decoded_sha256"]
            )

    kinds = dict(docs.dtypes)
    schema = ", ".join(
        [*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long", "ids array<int>", "decoded_sha256 string"]
    )
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded, in one pass."""
    shared.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
        for rows, data, off in blocks(batches, size=1 << 20):
            ids, count = model.encode(_texts(data, off))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), pa.array(count, pa.int64()), sha(model.listed(ids, count)),
                    sha(model.decode(ids, count))
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
