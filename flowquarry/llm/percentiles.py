"""Percentiles of very large numeric columns from mergeable sketches: the dyadic Count-sketch.

A finite value is encoded as the leading 24 bits of its double, in an order-preserving form; values of one code lie
within a relative 2^-13 of its middle. For each of the 8 finest binary resolutions of the codes a signed sketch (ROWS x
WIDTH counters) estimates how many values lie in a dyadic interval; the next resolution, a 32nd of an octave, has plain
counters. Percentiles are always read off the counters, by descending the resolutions, whatever the size of a group.
Sketches add up and subtract, over partitions, days and sources.

Counters are a linear function of the codes' counts, so a state is sent in the smaller of two forms: the counters, or,
as long as they take less room, the codes with their counts, which stand for the very same counters. Which form a state
has makes no difference to any result. Rows are turned into states within their partition, in blocks; states, not values,
are shuffled. They are merged first within partitions and then one after another by key, so that the memory of a task
is that of one state, however many there are of a key.

The bound on the rank is a theorem's, with failure probability DELTA for a percentile: in a row, the estimate of a rank
is off by the sum of what shares a counter with its nodes. It shares one with any of the HEAVY largest nodes of a level
with probability at most LEVELS * HEAVY / WIDTH; what the others add has mean 0 and a variance of at most the sum of
their second moments / WIDTH, which the counters give without their HEAVY largest (Chebyshev's inequality). The median
of five rows is off only if three are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24
EXACT_BITS = 16
ROWS, WIDTH = 5, 2048
LEVELS = BITS - EXACT_BITS  # resolutions with a sketch: 0 (codes) to LEVELS - 1
BLOCK = 250_000
COUNTERS = (1 << EXACT_BITS) + LEVELS * ROWS * WIDTH
RELATIVE_ERROR = 2.0**-13
DELTA, HEAVY = 0.01, 4
#: Standard deviations of the bound: 10 * 2 * p^3 = DELTA for a row's failure p, at both ends of a code's ranks.
_SPREAD = ((DELTA / 20) ** (1 / 3) - LEVELS * HEAVY / WIDTH) ** -0.5
_DROPPED = 64 - BITS
_ZERO = 1 << (BITS - 1)
_TOP = np.int64(0x7FFFFFFFFFFFFFFF)


def cells_of(v: np.ndarray) -> np.ndarray:
    """Codes of finite doubles; they never fall where values rise."""
    b = (np.asarray(v, np.float64) + 0.0).view(np.int64)
    return ((b ^ ((b >> 63) & _TOP)) >> _DROPPED) + _ZERO


def value_of(cell: np.ndarray) -> np.ndarray:
    """Middle of each code's values."""
    x = ((np.asarray(cell, np.int64) - _ZERO) << _DROPPED) + (1 << (_DROPPED - 1))
    v = (x ^ ((x >> 63) & _TOP)).view(np.float64)
    return np.where(np.asarray(cell) == _ZERO, 0.0, v)


_LEVEL, _ROW = np.arange(LEVELS)[:, None, None], np.arange(ROWS)[None, :, None]
_SEEDS = ((_LEVEL * ROWS + _ROW + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)


def _places(node: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column and sign of nodes in the rows of a level that the seeds belong to."""
    x = node.astype(np.uint64) + seeds
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x & np.uint64(WIDTH - 1)).astype(np.int64), 1 - 2 * ((x >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


def counters_of(cells: np.ndarray, counts: np.ndarray, owner: np.ndarray | None = None, owners: int = 1) -> np.ndarray:
    """Counters of the states that own the codes, one row per owner."""
    own = (np.zeros(len(cells), np.int64) if owner is None else owner) * COUNTERS
    out = np.zeros(owners * COUNTERS, np.int64)
    np.add.at(out, own + (cells >> LEVELS), counts)
    step = max(1, 4_000_000 // (LEVELS * ROWS))
    for i in range(0, len(cells), step):
        col, sign = _places(cells[None, None, i : i + step] >> _LEVEL, _SEEDS)
        at = own[i : i + step] + (1 << EXACT_BITS) + (_LEVEL * ROWS + _ROW) * WIDTH + col
        np.add.at(out, at.ravel(), (sign * counts[i : i + step]).ravel())
    return out.reshape(owners, COUNTERS)


class State:
    """A sketch in one of its two forms."""

    def __init__(self) -> None:
        self.pieces: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        self.counters: np.ndarray | None = None

    def add(self, blob: bytes, weight: int = 1) -> State:
        if blob[0]:
            got = np.frombuffer(blob, np.int64, offset=8) * weight
            self.counters = got if self.counters is None else self.counters + got
        else:
            n = (len(blob) - 8) // 12
            counts = np.frombuffer(blob, np.int64, count=n, offset=8)
            self.add_cells(np.frombuffer(blob, np.int32, count=n, offset=8 + 8 * n).astype(np.int64), counts * weight)
        return self

    def add_cells(self, cells: np.ndarray, counts: np.ndarray) -> State:
        self.pieces.append((cells, counts))
        self.size += len(cells)
        if 12 * self.size > 32 * COUNTERS:
            self.fold()
        return self

    def fold(self) -> State:
        """Codes once each; counters if they are the smaller form, or if a part of the state has no other form."""
        if self.pieces:
            cells, at = np.unique(np.concatenate([c for c, _ in self.pieces]), return_inverse=True)
            counts = np.zeros(len(cells), np.int64)
            np.add.at(counts, at, np.concatenate([n for _, n in self.pieces]))
            cells, counts = cells[counts != 0], counts[counts != 0]
            if self.counters is not None or 12 * len(cells) > 8 * COUNTERS:
                got = counters_of(cells, counts)[0]
                self.counters = got if self.counters is None else self.counters + got
                cells, counts = cells[:0], counts[:0]
            self.pieces, self.size = ([(cells, counts)] if len(cells) else []), len(cells)
        return self

    def blob(self) -> bytes:
        self.fold()
        if self.counters is not None:
            return b"\x01" + bytes(7) + self.counters.tobytes()
        cells, counts = self.pieces[0] if self.pieces else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return bytes(8) + counts.tobytes() + cells.astype(np.int32).tobytes()


def all_counters(states: Sequence[State]) -> np.ndarray:
    """Counters of each state, as rows."""
    parts = [(s.fold().pieces or [(np.zeros(0, np.int64), np.zeros(0, np.int64))])[0] for s in states]
    owner = np.repeat(np.arange(len(states)), [len(c) for c, _ in parts])
    out = counters_of(np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts]), owner, len(states))
    for k, s in enumerate(states):
        if s.counters is not None:
            out[k] += s.counters
    return out


def quantiles(counters: np.ndarray, probs: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Values at ranks ceil(p * n) (states x probs, NaN for empty states), and the bound on the error in ranks of each state.

    A descent keeps, for each row of counters, that row's estimate of the rank at which its node begins.
    """
    size = len(counters)
    tables = counters[:, 1 << EXACT_BITS :].reshape(size, LEVELS, ROWS, WIDTH)
    upto = np.cumsum(counters[:, : 1 << EXACT_BITS], axis=1)
    n = upto[:, -1]
    rank = np.maximum(1, np.ceil(np.asarray(probs)[None, :] * n[:, None] - 1e-9))
    node = np.array([np.searchsorted(np.maximum.accumulate(u), r) for u, r in zip(upto, rank)]).reshape(rank.shape)
    node = np.minimum(node, (1 << EXACT_BITS) - 1)
    which = np.arange(size)[:, None]
    begin = np.where(node > 0, upto[which, np.maximum(node - 1, 0)], 0)
    rows = np.repeat(begin[:, None, :], ROWS, axis=1).astype(float)
    which, row = which[:, :, None], np.arange(ROWS)[None, :, None]
    for level in range(LEVELS - 1, -1, -1):
        left = node * 2
        col, sign = _places(left[:, None, :], _SEEDS[level][None])
        end = rows + sign * tables[which, level, row, col]
        right = rank > np.partition(end, ROWS // 2, axis=1)[:, ROWS // 2]
        rows = np.where(right[:, None, :], end, rows)
        node = left + right
    size_of = np.abs(tables).astype(float)
    rest = np.einsum("slrw,slrw->slr", size_of, size_of)
    for _ in range(HEAVY):
        at = size_of.argmax(3)[..., None]
        rest -= np.take_along_axis(size_of, at, 3)[..., 0] ** 2
        np.put_along_axis(size_of, at, 0.0, 3)
    variance = np.median(np.maximum(rest, 0.0), axis=2).sum(1) / WIDTH
    return np.where(n[:, None] > 0, value_of(node), np.nan), np.where(n > 0, _SPREAD * np.sqrt(variance), 0.0)


def _names(by: Sequence[str]) -> list[str]:
    return [*by, "measure"]


def sketch_states(df: DataFrame, by: Mapping[str, Column], measures: Sequence[str], *, weight: Column | None = None) -> DataFrame:
    """States by the given keys: (keys..., measure, n, missing, non_finite, state), one row per key and measure.

    missing counts null and NaN, non_finite both infinities; n is the number of finite values. Null keys form groups
    of their own; repeated rows count as often as they come, with weight (a whole number, 1 by default) -1 they are
    taken out. An empty table gives no rows.
    """
    keys = [f"k{i}" for i in range(len(by))]
    rows = df.select(*[c.alias(k) for k, c in zip(keys, by.values())], (F.lit(1) if weight is None else weight).cast("long").alias("w"), *[F.col(f"`{m}`").cast("double").alias(f"m{j}") for j, m in enumerate(measures)])
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "measure string, n long, missing long, non_finite long, state binary"])

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            parts = [t.column(k).combine_chunks() if t.column(k).num_chunks != 1 else t.column(k).chunk(0) for k in keys]
            group = np.zeros(t.num_rows, np.int64)
            for p in parts:
                d = pc.dictionary_encode(p, null_encoding="encode")
                group = group * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)
                group = np.unique(group, return_inverse=True)[1]
            groups = int(group.max()) + 1
            first = np.full(groups, -1, np.int64)
            first[group[::-1]] = np.arange(t.num_rows)[::-1]
            w = t.column("w").to_numpy()
            heads = [p.take(pa.array(first)) for p in parts]
            for j, name in enumerate(measures):
                v = t.column(f"m{j}").to_numpy(zero_copy_only=False)
                finite, lost = np.isfinite(v), np.isnan(v)
                count = lambda m: np.bincount(group[m], weights=w[m], minlength=groups).astype(np.int64)  # noqa: B023, E731
                n, missing, non = count(finite), count(lost), count(~finite & ~lost)
                g, c, x = group[finite], cells_of(v[finite]), w[finite]
                one, at = np.unique(g * (1 << BITS) + c, return_inverse=True)
                sums = np.bincount(at, weights=x, minlength=len(one)).astype(np.int64) if len(one) else np.zeros(0, np.int64)
                cuts = np.searchsorted(one >> BITS, np.arange(groups + 1))
                cell = one & ((1 << BITS) - 1)
                blobs = [State().add_cells(cell[a:b], sums[a:b]).blob() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([*heads, pa.array([name] * groups), pa.array(n), pa.array(missing), pa.array(non), pa.array(blobs, pa.binary())], names=[*keys, "measure", "n", "missing", "non_finite", "state"])

        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= BLOCK:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    built = rows.mapInArrow(build, schema).toDF(*by, "measure", "n", "missing", "non_finite", "state")
    return _merged(built, _names(list(by)))


def _merge_runs(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merge neighbouring rows of equal keys, within partitions."""
    names = df.columns

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, sums, out = None, State(), [0, 0, 0], []
        schema = None
        weight = 0
        for b in batches:
            schema = b.schema
            cols = [b.column(c).to_pylist() for c in by]
            for k, n, m, f, blob in zip(zip(*cols), *(b.column(c).to_pylist() for c in ("n", "missing", "non_finite", "state"))):
                if k != key:
                    if key is not None:
                        out.append((*key, *sums, state.blob()))
                        weight += len(out[-1][-1])
                    key, state, sums = k, State(), [0, 0, 0]
                    if weight > 1 << 24 or len(out) > 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                        out, weight = [], 0
                state.add(blob)
                sums = [sums[0] + n, sums[1] + m, sums[2] + f]
        if key is not None:
            out.append((*key, *sums, state.blob()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return df.select(*by, "n", "missing", "non_finite", "state").mapInArrow(merge, df.select(*by, "n", "missing", "non_finite", "state").schema).select(*names)


def _merged(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return _merge_runs(df.repartition(*by).sortWithinPartitions(*by), by)


def merge_states(states: DataFrame, by: Mapping[str, Column]) -> DataFrame:
    """States of unions: by maps the keys wanted to expressions over the states' keys (a null literal for a union over all)."""
    wanted = states.select(*[c.alias(k) for k, c in by.items()], "measure", "n", "missing", "non_finite", "state")
    keys = _names(list(by))
    return _merged(_merge_runs(wanted.sortWithinPartitions(*keys), keys), keys)


def subtract_states(states: DataFrame, gone: DataFrame, by: Sequence[str]) -> DataFrame:
    """states without the rows that gone was built from (which must be among those of states)."""

    def negate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = [State().add(x, -1).blob() for x in b.column("state").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, t.type) if t.name == "state" else (pc.negate(b.column(t.name)) if t.name in ("n", "missing", "non_finite") else b.column(t.name)) for t in b.schema], schema=b.schema)

    return _merged(states.unionByName(gone.mapInArrow(negate, gone.schema)), _names(by))


def percentiles(states: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The states' keys and counts with a column per percentile (p50 and so on) and the bounds on the error.

    rank_error: bound in ranks, which holds for a percentile with probability 1 - DELTA; value_error: bound on the
    relative error of a value of the rank found. Groups without finite values give nulls.
    """
    keys = [c for c in states.columns if c not in ("n", "missing", "non_finite", "state")]
    labels = [f"p{100 * p:g}".replace(".", "_") for p in probs]
    types = dict(states.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "n long, missing long, non_finite long", *(f"{c} double" for c in labels), "rank_error double, value_error double"])

    def invert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, bounds = [np.zeros((0, len(probs)))], [np.zeros(0)]
            blobs = b.column("state")
            for i in range(0, b.num_rows, 8):
                q, e = quantiles(all_counters([State().add(x.as_py()) for x in blobs[i : i + 8]]), probs)
                values.append(q)
                bounds.append(e)
            q = np.concatenate(values)
            cols = [pa.array(q[:, i], mask=np.isnan(q[:, i])) for i in range(len(probs))]
            kept = [b.column(c) for c in (*keys, "n", "missing", "non_finite")]
            yield pa.RecordBatch.from_arrays([*kept, *cols, pa.array(np.concatenate(bounds)), pa.array(np.full(b.num_rows, RELATIVE_ERROR))], names=[*keys, "n", "missing", "non_finite", *labels, "rank_error", "value_error"])

    return states.mapInArrow(invert, schema)
