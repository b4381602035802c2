"""Substring deduplication by level-wise doubling.

A word is removed when a window of ``WINDOW`` consecutive words that covers it
also starts in a document with a smaller id; windows are judged on the input.

Levels double: windows repeated at one length alone are extended to twice that
length, until no candidates survive.

* The first level has windows of half the length (7 of 13, two of which sharing a
  word make one of 13).  Only one window per stretch is looked at: in every window
  of full length the half-length window with the least hash.  Equal texts choose
  alike, so a repeated full window always has a repeated chosen half, and about a
  quarter of the words are enough.
* The second level has the windows of 13 words around the halves that several
  documents have.  It decides what is removed: each window that several documents
  have is of the least of them or has a smaller one.
* Each further level (26, 52, 104, ... words) has the windows made of two of the
  level before that follow one another, all of whose 13-word windows several
  documents have; hashes are made of the halves' hashes, so texts aren't read
  again.  Again one window per stretch is looked at: of each stretch of twice the
  length the one with the least hash, so a passage of 2n words that documents
  share always has a window at level n.  A document whose windows of one length
  are all its own leaves; the levels end when no document is left.  The longest
  level of each document is its ``longest_repeat``: no longer than its longest
  shared passage and more than a quarter of it.

Rows are not words.  A task packs the hashes of about ``FLUSH`` bytes of text
into one binary row for each bucket of hash values, after resolving what it can
by itself: of a hash that it saw in several documents only the entries of the
least document are sent.  A passage that any number of documents share therefore
costs an entry for each ``FLUSH`` bytes of text.  The number of buckets follows
the bytes of all texts (``PER_BUCKET``), and findings go to the documents' parts
only where there are any.  Half windows are compared by 64 bits, full ones by
another 96, longer ones by 64 made of those.  Texts are dealt by id once and meet
the findings of their documents where they lie.

Defined results: null and empty texts have no words; texts of any length are
read whole; documents below 13 words lose none; ties (one id with the same
window twice) remove nothing; repeated rows of one id count as one document, and
each is returned; rows with a null id are neither judged nor witnesses; an empty
table gives an empty result; columns besides id and text are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .textops import U64, WHITE, Block, blocks, mix, per_doc, windows

WINDOW = 13
FLUSH = 16 << 20
#: Bytes of text for each bucket of hash values: about as many bytes of entries at the first level.
PER_BUCKET = 16 << 20
_ROW = "bucket int, hash binary, more binary, doc binary, at binary, known binary"
_PART = "part int, doc binary, at binary, hash binary, low binary"
_FOUND = "doc_id long, at binary, hash binary, low binary"
_TYPES = (("hash", np.uint64), ("more", np.uint32), ("doc", np.int64), ("at", np.int32), ("known", np.uint8))


def chosen(h: np.ndarray, b: Block, window: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of full windows; of each, the start of its chosen half; the hashes of all halves."""
    g = windows(h, half)
    full = np.flatnonzero(b.valid(window))
    span = window - half + 1
    key = g & ~U64(63)
    best = key.copy()  # the least hash, the rightmost on ties, its distance in the low bits
    for j in range(1, span):
        ahead = np.roll(key, -j)
        best = np.where(ahead <= (best & ~U64(63)), ahead | U64(j), best)
    at = full + (best[full] & U64(63)).astype(np.int64)
    return full, at, g


def _steps(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Differences of neighbours, each run from ``heads`` on by itself: small numbers, which compress."""
    out = np.diff(x, prepend=x[:1] * 0)
    out[heads] = x[heads]
    return out


def _places(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers that ``_steps`` made differences of, by sizes of the runs."""
    total = np.cumsum(steps, dtype=np.int64)
    before = np.concatenate([[0], total])[np.cumsum(sizes) - sizes]
    return (total - np.repeat(before, sizes)).astype(np.int32)


def _pack(bucket: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket, columns as bytes; ``bucket`` is sorted, and each bucket's entries by document and place."""
    heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
    h, more, doc, at, known = cols
    got, packed = _cut(bucket, [h, more, doc, _steps(at, heads), known])
    out = [pa.array(got.astype(np.int32)), *(pa.array(x, pa.binary()) for x in packed)]
    return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in _ROW.split(", ")])


def _groups(h: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads of runs of equal windows, and each entry's head."""
    new = np.append(True, (h[1:] != h[:-1]) | (more[1:] != more[:-1]))[: len(h)]
    return new, np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))


def _send(entries: list[tuple[np.ndarray, ...]], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Resolve within the task, then pack.

    Entries: hash, more, doc, at.  Those with a smaller document here leave as bucket -1.  Those of the least document
    are sent on, marked as known if others have left.
    """
    h, more, doc, at = (np.concatenate(x) for x in zip(*entries, strict=True))
    order = np.lexsort((at, doc, more, h))
    h, more, doc, at = h[order], more[order], doc[order], at[order]
    new, head = _groups(h, more)
    local = doc != doc[head]
    several = np.bincount(np.cumsum(new) - 1, weights=local) > 0
    known = several[np.cumsum(new) - 1].astype(np.uint8)
    if local.any():
        local = np.flatnonzero(local)[np.lexsort((at[local], doc[local]))]
        yield _pack(np.full(len(local), -1), [h[local], more[:0], doc[local], at[local], known[:0]])
    sent = doc == doc[head]
    h, more, doc, at, known = (x[sent] for x in (h, more, doc, at, known))
    bucket = (h >> U64(20)) % U64(n_buckets)
    order = np.lexsort((at, doc, bucket))
    yield _pack(bucket[order].astype(np.int64), [x[order] for x in (h, more, doc, at, known)])


def _cut(order_by: np.ndarray, cols: list[np.ndarray]) -> tuple[np.ndarray, list[list[bytes]]]:
    """Distinct values of a sorted array, and the bytes of each column for each of them."""
    heads = np.flatnonzero(np.append(True, order_by[1:] != order_by[:-1])[: len(order_by)])
    span = list(zip(heads.tolist(), np.append(heads[1:], len(order_by)).tolist(), strict=False))
    raw = [(np.ascontiguousarray(c).tobytes(), c.dtype.itemsize) for c in cols]
    return order_by[heads], [[r[a * w : b * w] for a, b in span] for r, w in raw]


def _by_part(h: np.ndarray, doc: np.ndarray, at: np.ndarray, low: np.ndarray, parts: int, places: bool) -> pd.DataFrame:
    """Findings, one row for each part of the documents that has any; ``places``: nothing but where they are."""
    if places:
        h, low = h[:0], low[:0]
    part = ((mix(doc.astype(U64)) >> U64(20)) % U64(parts)).astype(np.int32)
    order = np.lexsort((at, doc, part))
    part, at = part[order], at[order]
    at = _steps(at, np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]))
    part, (d, a, hs, lo) = _cut(part, [doc[order], at, *(x[order] if len(x) else x for x in (h, low))])
    return pd.DataFrame({"part": part, "doc": d, "at": a, "hash": hs, "low": lo})


def _by_doc(p: pd.DataFrame) -> pd.DataFrame:
    """A part's documents, each with its findings in order of position."""
    kinds = (("doc", np.int64), ("at", np.int32), ("hash", np.uint64), ("low", np.uint8))
    doc, at, h, low = (np.frombuffer(b"".join(p[c]), t) for c, t in kinds)
    at = _places(at, p["at"].map(len).to_numpy(np.int64) // 4)
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    once = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))[: len(doc)]  # a repeated row found the same again
    order, doc, at = order[once], doc[once], at[once]
    at = _steps(at, np.flatnonzero(np.append(True, doc[1:] != doc[:-1])[: len(doc)]))
    doc, (a, hs, lo) = _cut(doc, [at, *(x[order] if len(x) else x for x in (h, low))])
    return pd.DataFrame({"doc_id": doc, "at": a, "hash": hs, "low": lo})


def _unpack(p: pd.DataFrame) -> list[np.ndarray]:
    h, more, doc, at, known = (np.frombuffer(b"".join(p[c]), t) for c, t in _TYPES)
    return [h, more, doc, _places(at, p["at"].map(len).to_numpy(np.int64) // 4), known]


def _meet(parts: int, places: bool):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        """A bucket's windows that several documents have; low: not the least document's."""
        h, more, doc, at, known = _unpack(p)
        order = np.lexsort((doc, more, h))
        h, more, doc, at, known = (x[order] for x in (h, more, doc, at, known))
        new, head = _groups(h, more)
        low = doc != doc[head]
        hit = (np.bincount(np.cumsum(new) - 1, weights=low | (known > 0)) > 0)[np.cumsum(new) - 1]
        return _by_part(h[hit], doc[hit], at[hit], low[hit].astype(np.uint8), parts, places)

    return run


def _level(sent: DataFrame, parts: int, name: str, places: bool = False) -> DataFrame:
    """From a table of entries: the windows that several documents have, one row per document.

    With places, hashes and whether a smaller document has them.  The table is dropped.
    """
    met = sent.where("bucket >= 0").groupBy("bucket").applyInPandas(_meet(parts, places), _PART)

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                h, _, doc, at, _ = _unpack(p)
                yield _by_part(h, doc, at, np.ones(len(doc), np.uint8), parts, places)

    near = sent.where("bucket < 0").mapInPandas(local, _PART)
    found = shared.table(met.unionByName(near).groupBy("part").applyInPandas(_by_doc, _FOUND), name)
    shared.drop(sent)
    return found


def _held(entries: Iterator[tuple[tuple[np.ndarray, ...], int]], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Sends entries, with the bytes that each part of them stands for, a flush at a time."""
    held, size = [], 0
    for part, n in entries:
        held.append(part)
        size += n
        if size >= FLUSH:
            yield from _send(held, n_buckets)
            held, size = [], 0
    if held:
        yield from _send(held, n_buckets)


def _halves(n_buckets: int, window: int, half: int):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[np.ndarray, ...], int]]:
        for rows, data, off in blocks(batches):
            b = Block(data, off)
            if len(b.start) >= window:
                _, at, g = chosen(b.hashes(), b, window, half)
                at = np.unique(at)
                d = b.doc_of_word()[at]
                ids = np.asarray(rows.column("doc_id"))[d]
                yield (g[at], np.zeros(len(at), np.uint32), ids, (at - b.first[d]).astype(np.int32)), len(data)

    return lambda batches: _held(entries(batches), n_buckets)


def _flagged(lists: pa.Array, b: Block, length: int, only: pa.Array | None = None) -> np.ndarray:
    """Word-wise flags from each document's list of packed starts of windows of ``length`` words; ``only``: bytes not 0."""
    out = np.zeros(len(b.start), bool)
    marks = [None] * len(lists) if only is None else only.to_pylist()
    for i, (x, mark) in enumerate(zip(lists.to_pylist(), marks, strict=True)):
        if x:
            at = np.cumsum(np.frombuffer(x, np.int32), dtype=np.int64)
            if mark is not None:
                at = at[np.frombuffer(mark, np.uint8) > 0]
            out[at[at <= b.first[i + 1] - b.first[i] - length] + b.first[i]] = True  # rows of one id may differ in text
    return out


def _fulls(n_buckets: int, window: int, half: int):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[np.ndarray, ...], int]]:
        for rows, data, off in blocks(batches):
            b = Block(data, off)
            if len(b.start) < window:
                continue
            h = b.hashes()
            full, at, _ = chosen(h, b, window, half)
            full = full[_flagged(rows.column("at"), b, half)[at]]
            if len(full):
                d = b.doc_of_word()[full]
                one = windows(h, window, 0xC2B2AE3D27D4EB4F)[full]
                more = (windows(mix(h ^ U64(0x165667B19E3779F9)), window)[full] >> U64(32)).astype(np.uint32)
                yield (
                    one, more, np.asarray(rows.column("doc_id"))[d], (full - b.first[d]).astype(np.int32)
                ), 8 * len(full)

    return lambda batches: _held(entries(batches), n_buckets)


def _slide(x: np.ndarray, span: int, best: np.ufunc) -> np.ndarray:
    """``best`` of each ``span`` neighbours from each place on, by doubling; the last places have fewer."""
    size = 1
    while size * 2 <= span:
        x = np.append(best(x[:-size], x[size:]), x[len(x) - size :]) if len(x) > size else x
        size *= 2
    rest = span - size
    return np.append(best(x[:-rest], x[rest:]), x[len(x) - rest :]) if 0 < rest < len(x) else x


def _least(place: np.ndarray, h: np.ndarray, span: int) -> np.ndarray:
    """Which windows have the least hash of some ``span`` windows at neighbouring places."""
    if len(h) < span:
        return np.zeros(len(h), bool)
    whole = np.zeros(len(h), bool)
    whole[: len(h) - span + 1] = place[span - 1 :] - place[: len(h) - span + 1] == span - 1
    low = np.where(whole, _slide(h, span, np.minimum), U64(0))
    # the greatest of the least hashes of the spans that a window is in; it is the window's own if it's chosen
    return _slide(low[::-1], span, np.maximum)[::-1] == h


def _longer(window: int):
    """From the windows that several documents have: the chosen ones of each further level, a row for document and level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ats = rows.column("at").to_pylist()
            sizes = np.array([len(x) // 4 for x in ats], np.int64)
            at = _places(np.frombuffer(b"".join(ats), np.int32), sizes).astype(np.int64)
            place = np.repeat(np.arange(len(ats)), sizes) << 40 | at
            h = np.frombuffer(b"".join(rows.column("hash").to_pylist()), np.uint64)
            length = window
            while len(place):
                to = np.minimum(np.searchsorted(place, place + length), len(place) - 1)
                some = np.flatnonzero(place[to] == place + length)
                h = mix(mix(h[some]) * U64(0x9E3779B97F4A7C15) + mix(h[to[some]] ^ U64(0x2545F4914F6CDD1D)))
                place, length = place[some], 2 * length
                pick = _least(place, h, length + 1)
                got, (at, hs) = _cut(place[pick] >> 40, [(place[pick] & 0xFFFFFFFF).astype(np.int32), h[pick]])
                if len(got):
                    ids = rows.column("doc_id").take(pa.array(got))
                    cols = [
                        ids, pa.array(np.full(len(got), length)), pa.array(at, pa.binary()), pa.array(hs, pa.binary())
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "length", "at", "hash"])

    return run


def _again(n_buckets: int):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[np.ndarray, ...], int]]:
        for rows in batches:
            ats = rows.column("at").to_pylist()
            h = np.frombuffer(b"".join(rows.column("hash").to_pylist()), np.uint64)
            ids = np.repeat(np.asarray(rows.column("doc_id")), [len(x) // 4 for x in ats])
            if len(h):
                yield (h, np.zeros(len(h), np.uint32), ids, np.frombuffer(b"".join(ats), np.int32)), 8 * len(h)

    return lambda batches: _held(entries(batches), n_buckets)


def joined(b: Block, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Kept words of all documents, each followed by a space, and offsets of documents in that."""
    size = (b.end - b.start)[keep]
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    kept = b.data[~WHITE[b.data]][np.repeat(keep, b.end - b.start)]
    out[np.arange(len(kept)) + np.repeat(np.arange(len(size)), size)] = kept
    total = np.concatenate([[0], np.cumsum((b.end - b.start + 1) * keep)])
    return out.tobytes(), total[b.first]


def _result(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in blocks(batches):
            b = Block(data, off)
            gone = np.zeros(len(b.start), bool)
            starts = np.flatnonzero(_flagged(rows.column("at"), b, window, rows.column("low")))
            for j in range(window):
                gone[starts + j] = True
            raw, cut = joined(b, ~gone)
            span = zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)
            sha = [hashlib.sha256(raw[a : max(a, e - 1)]).hexdigest() for a, e in span]
            lost = pa.array(per_doc(gone, b.first))
            cols = [
                rows.column("doc_id"), pa.array(b.counts.astype(np.int64)), lost, pa.array(sha), rows.column("longest")
            ]
            yield pa.RecordBatch.from_arrays(
                cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "longest_repeat"]
            )

    return run


def repeated(known: DataFrame, n: int, window: int = WINDOW) -> DataFrame:
    """Windows of ``window`` words that several documents (doc_id, text; no null ids) have: one row per document."""
    half = (window + 1) // 2
    sent = shared.table(known.mapInArrow(_halves(n, window, half), _ROW), "halves-sent")
    halves = _level(sent, n, "halves", places=True)
    some = known.join(halves, "doc_id").select("doc_id", "text", "at")
    sent = shared.table(some.mapInArrow(_fulls(n, window, half), _ROW), "windows-sent")
    shared.drop(halves)
    return _level(sent, n, "windows")


def repeat_lengths(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and ``longest``: the longest level (``window``, twice, four times, ... words) at which it has a window left."""
    schema = "doc_id long, length long, at binary, hash binary"
    longer = shared.table(found.mapInArrow(_longer(window), schema), "longer")
    size = F.sum(F.length("at") + F.length("hash")).alias("size")
    sizes = {r["length"]: r["size"] for r in longer.groupBy("length").agg(size).collect()}  # one row a level
    left, seen, length = None, found.select("doc_id", F.lit(window).cast("long").alias("longest")), 2 * window
    while length in sizes:
        some = longer.where(F.col("length") == length)
        if left is not None:
            some = some.join(left.select("doc_id"), "doc_id", "left_semi")
        n = max(8, -(-sizes[length] // PER_BUCKET))
        left = _level(shared.table(some.mapInArrow(_again(n), _ROW), "left-sent"), n, "left", places=True)
        if left.isEmpty():
            break
        seen = seen.unionByName(left.select("doc_id", F.lit(length).cast("long").alias("longest")))
        length *= 2
    return seen.groupBy("doc_id").agg(F.max("longest").alias("longest"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, longest_repeat, one row per row of ``docs``; a table in the shared folder."""
    spark = shared.prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = shared.buckets(spark, shared.text_bytes(docs), PER_BUCKET)
    # rows without id share nothing with others: they stay where they are
    known, others = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    with shared.scratch() as keep, shared.bucketed(known, "doc_id", n) as dealt:
        found = repeated(dealt, n, window)
        longest = shared.table(repeat_lengths(found, window), "longest")
        x = dealt.join(found.drop("hash"), "doc_id", "left").join(longest, "doc_id", "left")
        x = x.select("doc_id", "text", "at", "low", F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))
        nothing = [F.lit(None).cast("binary").alias(c) for c in ("at", "low")]
        x = x.unionByName(others.select("doc_id", "text", *nothing, F.lit(0).cast("long").alias("longest")))
        schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, longest_repeat long"
        return keep(shared.table(x.mapInArrow(_result(window), schema), "substrings"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d),
w AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS w FROM p),
f AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY w) AS m FROM w) WHERE m < doc_id),
g AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM f)),
a AS (SELECT d.doc_id, j, ws[j] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM d) d),
k AS (SELECT a.doc_id, string_agg(w, ' ' ORDER BY a.j) AS t FROM a ANTI JOIN g ON a.doc_id = g.doc_id AND a.j = g.j GROUP BY a.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""
