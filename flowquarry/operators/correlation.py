"""Correlated columns, histograms and box-plot statistics: the data behind plots."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.scalars import is_finite, q, signed_log10
from flowquarry.operators.orderstats import exact_quantiles

#: Moments of a pair of columns: rows, means, sums of squares and products about the means, least and greatest values.
_STATE = ("n", "mean_a", "mean_b", "saa", "sbb", "sab", "lo_a", "hi_a", "lo_b", "hi_b")
_NONE = (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, np.inf, -np.inf, np.inf, -np.inf)


def _moments(a: np.ndarray, b: np.ndarray) -> tuple[float, ...]:
    if not len(a):
        return _NONE
    mean_a, mean_b = a.mean(), b.mean()
    da, db = a - mean_a, b - mean_b
    return len(a), mean_a, mean_b, da @ da, db @ db, da @ db, a.min(), a.max(), b.min(), b.max()


def _merged(parts: np.ndarray) -> np.ndarray:
    """States (part, pair, moment) as one state a pair; deviations of the parts' means are taken from the common mean."""
    n, mean_a, mean_b, saa, sbb, sab, lo_a, hi_a, lo_b, hi_b = np.moveaxis(parts, 2, 0)
    rows = n.sum(0)
    means = [(n * m).sum(0) / np.maximum(rows, 1) for m in (mean_a, mean_b)]
    da, db = mean_a - means[0], mean_b - means[1]
    sums = [s.sum(0) + (n * d).sum(0) for s, d in ((saa, da * da), (sbb, db * db), (sab, da * db))]
    return np.stack([rows, *means, *sums, lo_a.min(0), hi_a.max(0), lo_b.min(0), hi_b.max(0)], axis=1)


def correlations(df: DataFrame, columns: Sequence[str], *, min_rows: int = 30) -> DataFrame:
    """(column_a, column_b, r, n): Pearson's r over the rows where both are finite; null below min_rows or without spread.

    One scan; each task gives one state a pair, and the states of a pair are merged together.
    """
    pairs = list(itertools.combinations(range(len(columns)), 2))
    names = list(columns)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        with np.errstate(all="ignore"):
            for batch in batches:
                x = [c.to_numpy(zero_copy_only=False).astype("float64", copy=False) for c in batch.columns]
                finite = [np.isfinite(v) for v in x]
                part = np.array([_moments(x[a][both], x[b][both]) for a, b in pairs for both in (finite[a] & finite[b],)])
                total = part if total is None else _merged(np.stack([total, part]))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pairs)), pa.int32()), *[pa.array(total[:, i]) for i in range(len(_STATE))]], ["pair", *_STATE])

    def measured(parts: pa.Table) -> pa.Table:
        pair = parts.column("pair")[0].as_py()
        with np.errstate(all="ignore"):
            n, _, _, saa, sbb, sab, lo_a, hi_a, lo_b, hi_b = _merged(np.stack([parts.column(c).to_numpy() for c in _STATE], axis=1)[:, None, :])[0]
            r = sab / (np.sqrt(saa) * np.sqrt(sbb))
        known = n >= min_rows and lo_a < hi_a and lo_b < hi_b and np.isfinite(r)
        a, b = pairs[pair]
        return pa.table({"column_a": [names[a]], "column_b": [names[b]], "r": pa.array([float(r) if known else None], pa.float64()), "n": pa.array([int(n)], pa.int64())})

    schema = "column_a string, column_b string, r double, n long"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    fields = f"pair int, {', '.join(f'{c} double' for c in _STATE)}"
    d = df.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    empty = df.sparkSession.range(len(pairs)).select(F.col("id").cast("int").alias("pair"), *[F.lit(v).alias(c) for c, v in zip(_STATE, _NONE)])
    return d.mapInArrow(states, fields).unionByName(empty).groupBy("pair").applyInArrow(measured, schema)


def signed_log_histogram(df: DataFrame, column: str, by: Column, bins: int = 40) -> DataFrame:
    """(class, bin, n, density): bins of equal width over the signed logarithm, shared by all classes.

    The greatest value belongs to the last bin; density integrates to one per class. One value only: one bin.
    """
    x = F.when(is_finite(q(column).cast("double")), signed_log10(q(column).cast("double")))
    d = df.select(by.alias("class"), x.alias("x")).where("x is not null")
    ends = d.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    placed = d.crossJoin(F.broadcast(ends))  # one row
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), width)).cast("int")))
    counts = placed.groupBy("class", b.alias("bin"), width.alias("width")).agg(F.count("*").alias("n"))
    total = counts.groupBy(F.col("class").alias("c2")).agg(F.sum("n").alias("t"))
    return counts.join(total, F.col("class").eqNullSafe(F.col("c2"))).select("class", F.col("bin").cast("long").alias("bin"), "n", F.try_divide(F.col("n"), F.col("t") * F.col("width")).alias("density"))


def box_plot(df: DataFrame, label: str, column: str) -> DataFrame:
    """(label, q1, median, q3, low, high): exact quartiles, whiskers at the last values within 1.5 interquartile ranges."""
    qs = exact_quantiles(df, [label], column, [0.25, 0.5, 0.75])
    pick = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    box = qs.groupBy(label).agg(pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3")).withColumnRenamed(label, "__l")
    v = q(column).cast("double")
    rows = df.select(q(label).alias("label"), v.alias("v")).where(is_finite(F.col("v")))
    iqr = 1.5 * (F.col("q3") - F.col("q1"))
    j = rows.join(box, F.col("label").eqNullSafe(F.col("__l")))
    return j.groupBy("label", "q1", "median", "q3").agg(F.min(F.when(F.col("v") >= F.col("q1") - iqr, F.col("v"))).alias("low"), F.max(F.when(F.col("v") <= F.col("q3") + iqr, F.col("v"))).alias("high"))
