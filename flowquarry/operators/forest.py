"""Random forest of two classes: trees grow side by side, each from passes over one table of bin numbers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.scalars import q
from flowquarry.session import discard, stored

#: Rows of a block of bin numbers.
BLOCK = 1 << 18
#: Rows about which the cuts between bins are taken from; fewer rows: all of them.
CUT_ROWS = 1 << 16
#: Bytes of bin numbers that a task keeps; more are read again for each level.
HELD = 192 << 20

Blocks = Callable[[], Iterable[tuple[np.ndarray, np.ndarray]]]


def cuts_of(values: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 rising cuts halfway between neighbouring values, about as many values between any two of them."""
    v, n = np.unique(values, return_counts=True)
    if len(v) <= bins:
        at = np.arange(len(v) - 1)
    else:
        upto = np.cumsum(n)
        at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, bins) / bins))
        at = at[at < len(v) - 1]
    return np.unique(v[at] / 2 + v[at + 1] / 2)


def codes_of(columns: Sequence[np.ndarray], cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Rows x features bin numbers: a value lies in bin b or below if it is at most cut b."""
    out = np.empty((len(columns[0]), len(cuts)), np.uint8)
    for i, (x, c) in enumerate(zip(columns, cuts)):
        out[:, i] = np.searchsorted(c, x, side="left")
    return out


def grow(blocks: Blocks, features: int, bins: int, picked: int, depth: int, seed: int, tree: int) -> np.ndarray:
    """Nodes (feature, cut, left, rows of class 0, of class 1) of one tree; a leaf has feature -1, right is left + 1.

    Rows count as often as a Poisson number of mean 1 says, each node weighs the cuts of ``picked`` features by Gini
    impurity; depth is at least 1. One pass over the blocks per level; of a row that can still be split, its place, node and count are kept.
    Rows are counted a picked feature at a time: long plain arrays are several times as fast as ones with a short last axis.
    """
    rng = np.random.default_rng([seed, tree])
    nodes: list[np.ndarray] = []  # per level
    state: list[tuple[np.ndarray, ...]] = []
    open_, route, first = 1, None, 0
    for level in range(depth):
        chosen = np.argsort(rng.random((open_, features)), axis=1)[:, :picked]
        slots = np.ascontiguousarray(chosen.T)
        counts = np.zeros((picked, open_ * 2 * bins))  # feature, then node, class and bin
        for b, (codes, y) in enumerate(blocks()):
            if route is None:
                w = np.random.default_rng([seed, tree, b]).poisson(1.0, len(y)).astype(np.uint8)
                at = np.flatnonzero(w)
                here, node, w, y = at * features, np.zeros(len(at), np.intp), w.take(at), y.take(at)
            else:
                here, node, w, y = state[b]
                here, node = here.astype(np.intp), node.astype(np.intp)  # what take and bincount work with
                f, cut, follow = route
                side = codes.take(here + f.take(node)) > cut.take(node)
                node *= 2
                node += side
                node = follow.take(node)
                left = np.flatnonzero(node >= 0)
                if len(left) < len(node):
                    here, node, w, y = here.take(left), node.take(left), w.take(left), y.take(left)
            state[b : b + 1] = [(here.astype(np.int32), node.astype(np.int32), w, y)]
            if not len(node):
                continue
            base = node * 2
            base += y
            base *= bins
            weights = w.astype(float)
            for s in range(picked):
                where = slots[s].take(node)
                where += here
                counts[s] += np.bincount(codes.take(where) + base, weights, open_ * 2 * bins)
        counts = counts.reshape(picked, open_, 2, bins).transpose(1, 0, 3, 2)
        below = counts.cumsum(2)
        all_ = below[:, :, -1:, :]
        above = all_ - below
        ln, rn, n = below.sum(3), above.sum(3), all_.sum(3)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = ((below**2).sum(3) / ln + (above**2).sum(3) / rn - (all_**2).sum(3) / n) / n
        gain = np.where((ln > 0) & (rn > 0), gain, -1.0).reshape(open_, -1)
        best = gain.argmax(1)
        every = np.arange(open_)
        split = gain[every, best] > 1e-12
        slot, cut = best // bins, best % bins
        f = chosen[every, slot]
        halves = np.stack([below[every, slot, cut], above[every, slot, cut]], 1)  # node, side, class
        table = np.empty((open_, 5))
        table[:, 3:] = all_[:, 0, 0]
        table[:, 0], table[:, 1], table[:, 2] = np.where(split, f, -1), np.where(split, cut, 0), -1
        if level == 0:
            nodes.append(table)
        else:
            nodes[-1][again] = table  # noqa: F821  # places of these nodes among the level's
        children = np.flatnonzero(split)
        first += len(nodes[-1])
        place = np.arange(0, 2 * len(children), 2)
        rows = every if level == 0 else again  # noqa: F821
        nodes[-1][rows[children], 2] = first + place
        if not len(children):
            break
        kids = halves[children].reshape(-1, 2)
        nodes.append(np.column_stack([np.full(len(kids), -1.0), np.zeros(len(kids)), np.full(len(kids), -1.0), kids]))
        again = np.flatnonzero((kids > 0).all(1))
        if not len(again):
            break
        follow = np.full((open_, 2), -1, np.int32)
        number = np.full(len(kids), -1, np.int32)
        number[again] = np.arange(len(again))
        follow[children] = number.reshape(-1, 2)
        route = f, cut.astype(np.uint8), follow.ravel().astype(np.intp)
        open_ = len(again)
    return np.concatenate(nodes)


def _filled(x: np.ndarray, value: float) -> np.ndarray:
    return np.where(np.isnan(x), value, x)


def _truth(column: pa.Array) -> np.ndarray:
    if column.null_count:
        raise ValueError("a row has no truth")
    y = column.to_numpy(zero_copy_only=False)
    if ((y != 0) & (y != 1)).any():
        raise ValueError("truth is neither 0 nor 1")
    return y.astype(np.uint8)


class _Kept:
    """Rows of a block to be: bin numbers and truth."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, codes: np.ndarray, y: np.ndarray) -> None:
        self.parts.append((codes, y))
        self.rows += len(y)

    def block(self, model: int | None = None) -> pa.RecordBatch:
        codes, y = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.rows = [], 0
        cells = {"codes": pa.array([codes.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary())}
        return pa.RecordBatch.from_pydict(cells if model is None else {"m": pa.array([model], pa.int32())} | cells)


def _blocks(paths: Sequence[str], keep: bool) -> Blocks:
    def read() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for path in paths:
            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_file(name) as f:
                for batch in pq.ParquetFile(f).iter_batches(batch_size=1):
                    for codes, y in zip(batch.column("codes"), batch.column("y")):
                        yield np.frombuffer(codes.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)

    if not keep:
        return read
    held = list(read())
    return lambda: held


class ForestModel:
    """A fitted forest; the probability of class 1 is the mean over trees of its share of the leaf's rows."""

    def __init__(self, cuts: Sequence[np.ndarray], trees: Sequence[np.ndarray]):
        self.cuts, self.trees = [np.asarray(c, float) for c in cuts], [np.asarray(t, float) for t in trees]

    def score(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Probabilities of rows given as one array per feature."""
        if not hasattr(self, "_flat"):
            start = np.cumsum([0, *map(len, self.trees)])
            t = np.concatenate(self.trees)
            leaf = t[:, 0] < 0
            own = np.repeat(start[:-1], np.diff(start))
            # a leaf leads to itself: no bin number is above 255
            self._flat = start[:-1], np.where(leaf, 0, t[:, 0]).astype(np.intp), np.where(leaf, 255, t[:, 1]).astype(np.uint8), np.where(leaf, np.arange(len(t)), t[:, 2] + own).astype(np.intp), t[:, 4] / (t[:, 3] + t[:, 4]), [self._height(x) for x in self.trees]
        starts, feature, cut, left, value, heights = self._flat
        if not self.cuts:
            return np.full(len(columns[0]) if columns else 0, value[starts].mean())
        codes = codes_of(columns, self.cuts)
        here = np.arange(len(codes)) * len(self.cuts)
        total = np.zeros(len(codes))
        for s, h in zip(starts, heights):
            at = np.full(len(codes), s, np.intp)
            for _ in range(h):
                at = left.take(at) + (codes.take(here + feature.take(at)) > cut.take(at))
            total += value.take(at)
        return total / len(starts)

    @staticmethod
    def _height(t: np.ndarray) -> int:
        level, h = np.array([0]), 0
        while True:
            inner = level[t[level, 0] >= 0]
            if not len(inner):
                return h
            at = t[inner, 2].astype(int)
            level, h = np.concatenate([at, at + 1]), h + 1

    def probability(self, df: DataFrame, columns: Sequence[str]) -> Column:
        """The probability as a column over the features of df, in the order of the fit."""
        shared = df.sparkSession.sparkContext.broadcast(self)  # trees * 2 ** (depth + 1) nodes at most

        @F.pandas_udf("double")
        def p(*cols: pd.Series) -> pd.Series:
            return pd.Series(shared.value.score([c.to_numpy(float) for c in cols]))

        return p(*[F.col(c) for c in columns] or [F.lit(0.0)])

    def describe(self) -> dict:
        return {"cuts": [c.tolist() for c in self.cuts], "trees": [t.tolist() for t in self.trees]}


class Forest:
    """Fits a ForestModel to the columns __f0, __f1, ... (finite doubles) and the truth (0 or 1)."""

    def __init__(self, label: str, trees: int, depth: int, bins: int = 64, seed: int = 42):
        self.label, self.trees, self.depth, self.bins, self.seed = label, trees, depth, bins, seed

    def fit(self, df: DataFrame) -> ForestModel:
        """The rows are binned and stored once; then each task grows some of the trees over all of these blocks.

        A task keeps the blocks if they take at most HELD bytes, else it reads them again for each level; of the rows in
        a tree it keeps ten bytes each. Nothing but the trees comes to the driver, and some rows for the cuts between
        bins. Null truth and no rows are errors.
        """
        names = [c for c in df.columns if c.startswith("__f")]
        n = df.count()
        if not n:
            raise ValueError("no rows to fit on")
        some = df.select(*names).where(F.rand(self.seed) < CUT_ROWS / n) if n > CUT_ROWS else df.select(*names)
        sample = some.toArrow()
        cuts = [cuts_of(sample.column(c).to_numpy(), self.bins) for c in names]
        label = self.label

        def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = _Kept()
            for batch in batches:
                if not batch.num_rows:
                    continue
                y = _truth(batch.column(label))
                kept.add(codes_of([batch.column(c).to_numpy(zero_copy_only=False) for c in names], cuts) if names else np.zeros((len(y), 1), np.uint8), y)
                if kept.rows >= BLOCK:
                    yield kept.block()
            if kept.rows:
                yield kept.block()

        blocks = stored(df.select(*names, label).mapInArrow(encode, "codes binary, y binary"))
        try:
            return self._grown(df, blocks.inputFiles(), n, cuts)
        finally:
            discard(blocks)

    def fit_without(self, df: DataFrame, group: str, names: Sequence[str], fills: Mapping[str, Mapping[str, float]]) -> dict[str, ForestModel]:
        """For each group of fills the model of the rows of the other groups, all from the same three passes.

        df has the group (not null), columns (finite or null, as they are in names) and the truth. A model learns from
        the columns of its fills only, which say what stands for null. Cuts between bins, too, come from the rows of
        other groups only: a row is sampled if its random number is low enough for one of the models that learn from it.
        """
        label, bins = self.label, self.bins
        sizes = {r[0]: r[1] for r in df.groupBy(group).count().collect()}  # one number per group
        rows = {g: sum(sizes.values()) - sizes.get(g, 0) for g in fills}
        if not all(rows.values()):
            raise ValueError("no rows to fit on")
        rates = {g: CUT_ROWS / n if n > CUT_ROWS else 1.0 for g, n in rows.items()}
        top = max(rates, key=rates.get)
        others = max((r for g, r in rates.items() if g != top), default=0.0)
        cells = [f"c{i}" for i in range(len(names))]
        flat = df.select(F.col(group).alias("g"), *[q(c).alias(k) for c, k in zip(names, cells)], F.col(label).alias("y"))
        some = flat.select(F.rand(self.seed).alias("u"), "g", *cells).where(F.col("u") < F.when(F.col("g") == top, others).otherwise(rates[top])).toArrow()
        u, own, sample = some.column("u").to_numpy(), np.asarray(some.column("g").to_pylist(), object), [some.column(k).to_numpy() for k in cells]
        models = []  # group, and per feature its place, fill and cuts
        for g, fill in fills.items():
            mine = (own != g) & (u < rates[g])
            learned = [(i, fill[c]) for i, c in enumerate(names) if c in fill]
            models.append((g, [(i, x, cuts_of(_filled(sample[i][mine], x), bins)) for i, x in learned]))

        def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = [_Kept() for _ in models]
            for batch in batches:
                if not batch.num_rows:
                    continue
                groups = batch.column(0).dictionary_encode()
                place = groups.indices.to_numpy()
                x = [batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(len(cells))]
                y = _truth(batch.column(len(cells) + 1))
                for m, (g, features) in enumerate(models):
                    mine = np.flatnonzero(place != groups.dictionary.index(g).as_py())
                    kept[m].add(codes_of([_filled(x[i][mine], v) for i, v, _ in features], [c for _, _, c in features]) if features else np.zeros((len(mine), 1), np.uint8), y[mine])
                    if kept[m].rows >= BLOCK:
                        yield kept[m].block(m)
            for m, k in enumerate(kept):
                if k.rows:
                    yield k.block(m)

        blocks = stored(flat.mapInArrow(encode, "m int, codes binary, y binary"), "m")
        try:
            files = blocks.inputFiles()
            return {g: self._grown(df.where(F.col(group) != g), [f for f in files if f"/m={m}/" in f], rows[g], [c for _, _, c in features]) for m, (g, features) in enumerate(models)}
        finally:
            discard(blocks)

    def _grown(self, df: DataFrame, files: Sequence[str], n: int, cuts: Sequence[np.ndarray]) -> ForestModel:
        """The model of stored blocks of the n rows of df."""
        # Python reads by URI: a scheme that pyarrow knows
        paths, features, keep = sorted(files), max(1, len(cuts)), n * max(1, len(cuts)) <= HELD
        bins, depth, seed, label = self.bins, self.depth, self.seed, self.label
        picked = min(features, math.ceil(math.sqrt(features)))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            source = None
            for batch in batches:
                for t in batch.column("id").to_pylist():
                    source = source or _blocks(paths, keep)
                    nodes = grow(source, features, bins, picked, depth, seed, t)
                    yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int64()), "nodes": pa.array([nodes.tobytes()], pa.binary())})

        tasks = max(1, -(-self.trees // 2))
        got = df.sparkSession.range(0, self.trees, 1, tasks).mapInArrow(run, "tree long, nodes binary").collect()
        grown = [np.frombuffer(r["nodes"]).reshape(-1, 5).copy() for r in sorted(got, key=lambda r: r["tree"])]
        drawn = [t for t in grown if t[0, 3:].sum() > 0]  # of very few rows a tree may get none
        if not drawn:
            ones = df.agg(F.sum(label)).first()[0]
            drawn = [np.array([[-1.0, 0.0, -1.0, n - ones, ones]])]
        return ForestModel(cuts, drawn)
