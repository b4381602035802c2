"""Poisson bootstrap of any statistic that partial sums or counts of intervals can tell.

A row's weight in a repetition is a Poisson number of mean one, taken from a digest of its unit (a row's id, or a cluster's,
whose rows then weigh the same) and the repetition: the same in any partition, on any retry, and in any engine with md5 and
integers.  So repetitions need no table of draws and no collected column: each task sums its rows into a state of a few
numbers for each repetition, and states add up.

Ratios of sums (means, shares, regressions through the origin) come from one pass.  Quantiles come from counts over intervals
around the sample's quantile: the pass tells, for each repetition, the interval in which its quantile lies, and only rows of
such intervals are looked at again; an interval of more than ``MOST`` rows is divided further first.  However the intervals
are chosen, results are exact.  What reaches the driver is the states' sum, a row for each repetition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import exchange

#: Odd numbers of the mixing steps; their products with 32 bits fit 63 bits.
STRIDE, FACTOR = 0x9E3779B1, 0x45D9F3B
#: Weight k or more from these 32-bit numbers on: distribution function of a Poisson number of mean one.
LIMITS = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(13)]
#: Rows of an interval that one task looks at again; intervals on either side of a quantile; rows of a task.
MOST, SIDE, TASK_ROWS = 200_000, 16, 20_000
_ROWS, _REPS = 256, 500


@dataclass(frozen=True)
class Ratio:
    """Sum of ``num`` over sum of ``den``; without ``den``, the mean over rows whose ``num`` isn't null."""

    num: Column
    den: Column | None = None


@dataclass(frozen=True)
class Quantile:
    """Linear between the two nearest ranks; nulls and NaN don't count."""

    of: Column
    p: float


def share(condition: Column) -> Ratio:
    return Ratio(condition.cast("int"))


def words(unit: Column, seed: int) -> tuple[Column, Column]:
    """Two 32-bit numbers of a unit's digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), unit.cast("string")))
    part = lambda i: F.conv(F.substring(digest, i, 8), 16, 10).cast("long")
    return part(1), part(9)


def weights(a: np.ndarray, b: np.ndarray, reps: np.ndarray) -> np.ndarray:
    """Weight of each unit (rows) in each repetition (columns)."""
    x = a.astype(np.uint32)[:, None] + reps.astype(np.uint32)[None, :] * np.uint32(STRIDE)
    for other in (b.astype(np.uint32)[:, None], None, None):
        x ^= x >> np.uint32(16)
        x *= np.uint32(FACTOR)
        if other is not None:
            x ^= other
    x ^= x >> np.uint32(16)
    w = (x >= LIMITS[0]).view(np.uint8)
    for limit in LIMITS[1:5]:
        w += (x >= limit).view(np.uint8)
    rare = np.nonzero(x >= LIMITS[4])
    w[rare] = np.searchsorted(LIMITS, x[rare], "right")
    return w


def weight_sql(a: str, b: str, rep: str) -> str:
    """The same weight as SQL, from the two numbers and the repetition."""
    mask = 2**32 - 1
    x = f"(({a} + {rep} * {STRIDE}) & {mask})"
    mixed = lambda x: f"(((xor({x}, {x} >> 16)) * {FACTOR}) & {mask})"
    steps = [f"xor({mixed(x)}, {b})", mixed("x"), mixed("x"), "xor(x, x >> 16)"]
    inner = f"list_transform([{steps[0]}], lambda x: {steps[1]})"
    for s in steps[2:]:
        inner = f"list_transform({inner}, lambda x: {s})"
    return f"(list_transform({inner}, lambda x: {' + '.join(f'CAST(x >= {k} AS INT)' for k in LIMITS)})[1])"


def _around(p: float, n: int) -> list[float]:
    """Shares of rows within eight deviations of a quantile of a resample."""
    width = 8 * math.sqrt(p * (1 - p) / n) + 1 / n
    return [min(1.0, max(0.0, p + width * t / SIDE)) for t in range(-SIDE, SIDE + 1)]


def _split(edges: list[float]) -> np.ndarray:
    """Edges such that a value that is one has an interval of its own, however many rows have it."""
    e = np.unique(np.asarray(edges, float))
    return np.unique(np.concatenate([e, np.nextafter(e, np.inf)]))


def _states(rows: DataFrame, linear: int, edges: dict[int, np.ndarray], reps: np.ndarray, n: int) -> np.ndarray:
    """A row for each repetition, and one of plain counts: sums of the linear columns, then counts of each column's intervals."""
    size = linear + sum(len(e) + 1 for e in edges.values())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.zeros((size, len(reps) + 1))
        for batch in batches:
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            for at in range(0, batch.num_rows, _ROWS):
                part = {c: v[at : at + _ROWS] for c, v in cols.items()}
                sums = np.stack([part[f"l{i}"] for i in range(linear)]) if linear else None
                cells, first = [], linear
                for i, e in edges.items():
                    v = part[f"x{i}"].astype(float)
                    known = np.flatnonzero(part[f"k{i}"])
                    cell = np.searchsorted(e, v[known], "right")
                    order = np.argsort(cell, kind="stable")
                    starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
                    cells.append((known[order], starts, first + cell[order][starts]))
                    first += len(e) + 1
                for r in range(-1, len(reps), _REPS):
                    own = slice(r, r + _REPS) if r >= 0 else slice(0, _REPS - 1)
                    w = weights(part["a"], part["b"], reps[own])
                    to = slice(own.start + 1, own.start + 1 + w.shape[1])
                    if r < 0:
                        w = np.concatenate([np.ones((len(w), 1), np.uint8), w], axis=1)
                        to = slice(0, w.shape[1])
                    if linear:
                        state[:linear, to] += sums @ w.astype(float)
                    for order, starts, where in cells:
                        if len(order):
                            state[where, to] += np.add.reduceat(w[order], starts, axis=0, dtype=np.uint32)
        rep = pa.array(np.concatenate([[-1], reps]).astype(np.int64))
        yield pa.RecordBatch.from_arrays([rep, *map(pa.array, state)], ["rep", *[f"s{i}" for i in range(size)]])

    names = [f"s{i}" for i in range(size)]
    tasks = max(1, min(n // TASK_ROWS, 10 * rows.sparkSession.sparkContext.defaultParallelism))
    parts = rows.repartition(tasks).mapInArrow(each, ", ".join(["rep long", *[f"{c} double" for c in names]]))
    out = parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in names]).toPandas().sort_values("rep")
    return out[names].to_numpy()


def _ranked(rows: DataFrame, asked: list[tuple[float, float, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each interval (low, high, repetitions, ranks within it), the values of those ranks: a task for each interval."""
    least, most = min(low for low, *_ in asked), max(high for _, high, *_ in asked)
    rows = rows.where((F.col("x") >= F.lit(least)) & ((F.col("x") < F.lit(most)) | F.lit(most == math.inf)))
    bound = rows.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(low).alias("low"), F.lit(high).alias("high")) for i, (low, high, *_) in enumerate(asked)
    ])).alias("q"), "a", "b", "x").where("x >= q.low AND (x < q.high OR q.high = double('infinity'))")

    def one(t: pa.Table) -> pa.Table:
        i = t.column("i")[0].as_py()
        x, a, b = (t.column(c).to_numpy() for c in ("x", "a", "b"))
        order = np.lexsort((b, a, x))
        x, a, b = x[order], a[order], b[order]
        _, _, reps, ranks = asked[i]
        out = np.empty(len(reps))
        step = max(1, 4_000_000 // len(x))
        for at in range(0, len(reps), step):
            some = slice(at, at + step)
            ends = np.cumsum(weights(a, b, reps[some]), axis=0, dtype=np.int64)
            out[some] = x[(ends <= ranks[some]).sum(axis=0)]
        return pa.table({"i": pa.array(np.full(len(reps), i)), "at": pa.array(np.arange(len(reps))), "v": pa.array(out)})

    got = bound.select("q.i", "a", "b", "x").groupBy("i").applyInArrow(one, "i long, at long, v double").toPandas()
    return [g.sort_values("at").v.to_numpy() for _, g in sorted(got.groupby("i"))]


def _quantiles(rows: DataFrame, edges: np.ndarray, counts: np.ndarray, reps: np.ndarray, p: float) -> np.ndarray:
    """A quantile of each repetition from the counts of intervals (first row: plain counts)."""
    total = counts[1:].sum(axis=1)
    at = p * np.maximum(total - 1, 0)
    low, high = np.floor(at), np.ceil(at)
    ends = np.array([-np.inf, *edges, np.inf])
    values = [np.full(len(reps), np.nan) for _ in range(2)]
    todo = [(counts, ends, np.concatenate([np.flatnonzero(total > 0)] * 2), np.repeat([0, 1], int((total > 0).sum())),
             np.concatenate([low[total > 0], high[total > 0]]), np.arange(len(reps)))]
    last: list[tuple] = []
    while todo:
        counts, ends, rep, which, rank, of = todo.pop()
        before = np.cumsum(counts[1:], axis=1)
        row = np.searchsorted(of, rep)
        cell = (before[row] <= rank[:, None]).sum(axis=1)
        left = rank - np.where(cell > 0, before[row, np.maximum(cell - 1, 0)], 0)
        for c in np.unique(cell):
            mine, a, b = cell == c, ends[c], ends[c + 1]
            if np.nextafter(a, np.inf) == b:
                for k in (0, 1):
                    values[k][rep[mine & (which == k)]] = a
            elif counts[0, c] <= MOST:
                last.append((a, b, rep[mine], which[mine], left[mine]))
            else:
                some = rows.where((F.col("x") >= F.lit(float(a))) & ((F.col("x") < F.lit(float(b))) | F.lit(b == np.inf)))
                shares = [i / (2 * SIDE) for i in range(2 * SIDE + 1)]
                e = _split(some.agg(F.percentile_approx("x", shares, 100_000)).first()[0])
                e = e[(e > a) & (e < b)]
                again = np.unique(rep[mine])
                got = _states(some.select("a", "b", F.col("x").alias("x0"), F.lit(True).alias("k0")), 0, {0: e}, reps[again], int(counts[0, c]))
                todo.append((got, np.array([a, *e, b]), rep[mine], which[mine], left[mine], again))
    if last:
        found = _ranked(rows, [(float(a), float(b), reps[rep], left) for a, b, rep, _, left in last])
        for (_, _, rep, which, _), v in zip(last, found, strict=True):
            for k in (0, 1):
                values[k][rep[which == k]] = v[which == k]
    with np.errstate(invalid="ignore"):  # infinite values
        between = values[0] + (values[1] - values[0]) * (at - low)
    return np.where(values[0] == values[1], values[0], between)


def resample(df: DataFrame, unit: Column, stats: dict[str, Ratio | Quantile], reps: int, seed: int = 1) -> DataFrame:
    """rep and each statistic of ``df`` under that repetition's weights; null where nothing weighs (an empty table, too).

    Rows without a unit are one unit.  Runs its jobs when called.
    """
    a, b = words(F.coalesce(unit.cast("string"), F.lit("")), seed)
    linear: list[Column] = []
    quantiles: dict[str, tuple[int, Quantile]] = {}
    ratios: dict[str, int] = {}
    columns: list[Column] = []
    for name, s in stats.items():
        if isinstance(s, Ratio):
            den = s.num.isNotNull().cast("double") if s.den is None else s.den.cast("double")
            ratios[name] = len(linear)
            linear += [F.coalesce(s.num.cast("double"), F.lit(0.0)), F.coalesce(den, F.lit(0.0))]
        else:
            at = next((i for i, q in quantiles.values() if q.of is s.of), len(columns))
            columns += [s.of] if at == len(columns) else []
            quantiles[name] = (at, s)
    rows = df.select(
        a.alias("a"), b.alias("b"), *[c.alias(f"l{i}") for i, c in enumerate(linear)],
        *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)],
        *[(c.isNotNull() & ~F.isnan(c.cast("double"))).alias(f"k{i}") for i, c in enumerate(columns)],
    )
    with exchange.scratch():
        rows = exchange.table(rows, "bootstrap")
        known = rows.agg(F.count("*").alias("n"), *[F.count_if(f"k{i}").alias(f"n{i}") for i in range(len(columns))]).first()
        edges: dict[int, np.ndarray] = {}
        for i in range(len(columns)):
            if n := known[f"n{i}"]:
                near = [x for at, q in quantiles.values() if at == i for x in _around(q.p, n)]
                edges[i] = _split(rows.where(f"k{i}").agg(F.percentile_approx(f"x{i}", near, 100_000)).first()[0])
        every = np.arange(reps)
        out: dict[str, np.ndarray] = {"rep": every}
        if known["n"]:
            state = _states(rows, len(linear), edges, every, known["n"])
        for name in stats:
            value = np.full(reps, np.nan)
            if known["n"] and name in ratios:
                num, den = (state[1:, ratios[name] + j] for j in (0, 1))
                np.divide(num, den, out=value, where=den != 0)
            elif known["n"] and quantiles[name][0] in edges:
                i, q = quantiles[name]
                first = len(linear) + sum(len(e) + 1 for j, e in edges.items() if j < i)
                own = rows.where(f"k{i}").select("a", "b", F.col(f"x{i}").alias("x"))
                value = _quantiles(own, edges[i], state[:, first : first + len(edges[i]) + 1], every, q.p)
            out[name] = value
    frame = pd.DataFrame(out).astype(object).where(lambda x: x.notna(), None)
    schema = ", ".join(["rep long", *[f"{c} double" for c in stats]])
    return df.sparkSession.createDataFrame(frame.values.tolist(), schema)
