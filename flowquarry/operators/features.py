"""Learned preprocessing: what to drop, medians for what is missing, signed logarithm and scaling, all as one select."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.scalars import finite_or_null, q, signed_log1p
from flowquarry.operators.orderstats import column_quantiles


class SchemaError(ValueError):
    """A frame doesn't have the columns that a fitted preprocessor expects."""


@dataclass
class Preprocessor:
    """What was learned: the columns expected and kept, medians, and means and deviations of the scaled columns."""

    expected: list[str]
    kept: list[str]
    excluded: list[str] = field(default_factory=list)
    constant: list[str] = field(default_factory=list)
    duplicate_of: dict[str, str] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] | None = None
    deviations: dict[str, float] | None = None

    def describe(self) -> dict:
        return asdict(self)

    def expression(self, name: str) -> Column:
        x = F.coalesce(finite_or_null(q(name).cast("double")), F.lit(self.medians[name]))
        if self.means is None:
            return x
        dev = self.deviations[name]
        return (signed_log1p(x) - F.lit(self.means[name])) / F.lit(dev if dev else 1.0)

    def check(self, df: DataFrame) -> None:
        if missing := [c for c in self.expected if c not in df.columns]:
            raise SchemaError(f"missing columns: {missing}")

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """keep plus the kept columns, in the order learned; more columns are ignored, missing ones are an error.

        Text that is no number raises when it is read (ANSI cast).
        """
        self.check(df)
        return df.select(*[q(c) for c in keep], *[self.expression(c).alias(c) for c in self.kept])


def _states(df: DataFrame, columns: Sequence[str], group: str | None) -> list[dict]:
    """Per task and group: rows, and per column finite values, least and greatest, and the pairs of columns that are equal throughout."""
    width = len(columns)
    pairs = list(itertools.combinations(range(width), 2))
    by = q(group).cast("string") if group else F.lit("")
    flat = df.select(by.alias("g"), *[finite_or_null(q(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float) for i in range(width)])
            g = batch.column(0).dictionary_encode()
            place = g.indices.to_numpy()
            for k, name in enumerate(g.dictionary.to_pylist()):
                part = x[:, place == k]
                gone = np.isnan(part)
                s = states.setdefault(name, [0, np.zeros(width, np.int64), np.full(width, np.nan), np.full(width, np.nan), list(range(len(pairs)))])
                s[0] += part.shape[1]
                s[1] += (~gone).sum(1)
                s[2], s[3] = np.fmin(s[2], np.fmin.reduce(part, axis=1)), np.fmax(s[3], np.fmax.reduce(part, axis=1))
                part = np.where(gone, np.inf, part)  # values are finite
                s[4] = [p for p in s[4] if part[pairs[p][0], 0] == part[pairs[p][1], 0] and (part[pairs[p][0]] == part[pairs[p][1]]).all()]
        rows = [{"g": k, "n": s[0], "finite": s[1].tolist(), "lo": s[2].tolist(), "hi": s[3].tolist(), "alike": s[4]} for k, s in states.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("g", pa.string()), ("n", pa.int64()), ("finite", pa.list_(pa.int64())), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("alike", pa.list_(pa.int32()))]))

    if not width:
        return []
    return [r.asDict() for r in flat.mapInArrow(run, "g string, n long, finite array<long>, lo array<double>, hi array<double>, alike array<int>").collect()]


def _judged(states: Sequence[dict], columns: Sequence[str]) -> tuple[list[str], dict[str, str]]:
    """Constant columns and copies, from states."""
    if not states:
        return list(columns), {}
    rows = sum(s["n"] for s in states)
    finite = np.sum([s["finite"] for s in states], axis=0)
    lo, hi = np.fmin.reduce([s["lo"] for s in states]), np.fmax.reduce([s["hi"] for s in states])
    constant = [c for i, c in enumerate(columns) if finite[i] == 0 or (finite[i] == rows and lo[i] == hi[i])]
    pairs = list(itertools.combinations(columns, 2))
    copies: dict[str, str] = {}
    for p in sorted(set.intersection(*[set(s["alike"]) for s in states])):
        a, b = pairs[p]
        if a not in constant and b not in constant:
            copies.setdefault(b, a)
    return constant, copies


def uninformative(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], dict[str, str]]:
    """Constant columns (missing counts as a value), and for each copy of an earlier column that column.

    One pass compares all pairs of columns exactly; a pair that differs once is not compared again.
    """
    return _judged(_states(df, columns, None), columns)


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, median): exact, between the two middle values, of finite values only."""
    return column_quantiles(df, columns, [0.5]).select("column_name", F.col("quantile").alias("median"))


def fit_preprocessor(train: DataFrame, columns: Sequence[str], *, scale: bool = False, exclude: Sequence[str] = ("Destination Port",)) -> Preprocessor:
    """Learn from train only: excluded, constant and repeated columns go, medians fill, and (with scale) the scaled columns' moments."""
    used = [c for c in columns if c not in exclude]
    constant, copies = uninformative(train, used)
    kept = [c for c in used if c not in constant and c not in copies]
    # one number per column
    mid = {r["column_name"]: r["median"] for r in medians(train, kept).collect()} if kept else {}
    fitted = Preprocessor(list(columns), kept, [c for c in columns if c in exclude], constant, copies, {c: float(mid.get(c) or 0.0) for c in kept})
    return scaled(train, fitted) if scale else fitted


def fit_preprocessors_without(train: DataFrame, columns: Sequence[str], group: str, values: Sequence[str], *, exclude: Sequence[str] = ("Destination Port",)) -> dict[str, Preprocessor]:
    """For each value of group what fit_preprocessor learns from the rows of the other values, from passes over all rows.

    Rows without a group take no part. A group's states and counts are left out, or subtracted; of a value that no row has
    that is what all rows give.
    """
    used = [c for c in columns if c not in exclude]
    train = train.where(q(group).isNotNull())
    states = _states(train, used, group)
    judged = {v: _judged([s for s in states if s["g"] != v], used) for v in values}
    mid: dict[tuple[str, str], float] = {}
    if values and used:
        # one number per column and value
        mid = {(r["left_out"], r["column_name"]): r["quantile"] for r in column_quantiles(train, used, [0.5], without=(group, list(values))).collect()}
    out = {}
    for v, (constant, copies) in judged.items():
        kept = [c for c in used if c not in constant and c not in copies]
        out[v] = Preprocessor(list(columns), kept, [c for c in columns if c in exclude], constant, dict(copies), {c: float(mid.get((v, c)) or 0.0) for c in kept})
    return out


def scaled(train: DataFrame, fitted: Preprocessor) -> Preprocessor:
    """fitted with the moments of the scaled columns."""
    kept = fitted.kept
    if kept:
        fitted = replace(fitted)
        filled = {c: signed_log1p(F.coalesce(finite_or_null(q(c).cast("double")), F.lit(fitted.medians[c]))) for c in kept}
        row = train.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(filled.values()) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        fitted.means = {c: float(row[f"m{i}"] or 0.0) for i, c in enumerate(kept)}
        fitted.deviations = {c: float(row[f"s{i}"] or 0.0) for i, c in enumerate(kept)}
    return fitted
