"""Exact quantiles per group without bringing a group's values into one task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.scalars import finite_or_null, q
from flowquarry.session import stored

#: Buckets per unit of the signed logarithm.
GRAIN = 1024
#: Most rows of a table of wanted buckets that is broadcast (some 100 bytes each).
BROADCAST_ROWS = 50_000
#: Rows of which a task counts the buckets or values at once.
CHUNK = 1 << 18


def _bucket(v: Column) -> Column:
    """Never falls where v rises; at most some millions of buckets cover all doubles."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * F.lit(GRAIN)).cast("long")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], without: tuple[str, Sequence[str]] | None = None) -> DataFrame:
    """(by..., prob, quantile) with linear interpolation between the two values next to rank p * (n - 1).

    Null, NaN and infinite values are left out; groups without a finite value give no row; null group keys form a
    group of their own. Two passes over buckets that follow the order of the values: the first counts buckets, which
    are combined before the shuffle, and finds those of the ranks wanted; the second reads the values of these buckets
    only. With ``without`` (a column and some of its values) there is, for each of these values, a row (left_out, by...,
    prob, quantile) over the rows that have another value: counts are taken once and subtracted. The buckets wanted are broadcast if they are at most BROADCAST_ROWS, else joined by a shuffle.
    """
    v = F.col(f"`{value}`").cast("double")
    names = [f"g{i}" for i in range(len(by))]
    other = [F.col(f"`{without[0]}`").alias("o")] if without else []
    data = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(by, names)], *other, v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))))
    data = data.withColumn("v", F.col("v") + F.lit(0.0)).withColumn("b", _bucket(F.col("v")))
    if without:
        data = data.where("o is not null")
    data = data.withColumn("c", F.lit(1).cast("long"))
    return _from_counts(data, lambda wanted, sized, alike: data.join(sized(wanted), alike, "left_semi"), by, names, probs, without)


def _from_counts(first: DataFrame, again: Callable[[DataFrame, Callable[[DataFrame], DataFrame], Column], DataFrame], by: Sequence[str], own: Sequence[str], probs: Sequence[float], without: tuple[str, Sequence[str]] | None) -> DataFrame:
    """What exact_quantiles gives, from counts c of buckets b in first (of the same bucket in several rows, too).

    again gives the counts of the values v of the buckets wanted, from these (keys w0, ... and wb), what prepares them for
    a join, and its condition.
    """
    names = list(own)
    if without:
        names.append(f"g{len(names)}")
        by = [*by, "left_out"]

    def counted(d: DataFrame, *keys: str) -> DataFrame:
        if not without:
            return d.groupBy(*keys).agg(F.sum("c").alias("n"))
        per = d.groupBy(*keys, "o").agg(F.sum("c").alias("c")).groupBy(*keys).agg(F.sum("c").alias("c"), F.map_from_entries(F.collect_list(F.struct("o", "c"))).alias("m"))
        out = per.withColumn(names[-1], F.explode(F.array(*[F.lit(x) for x in without[1]])))
        return out.select(*keys, names[-1], (F.col("c") - F.coalesce(F.try_element_at("m", F.col(names[-1])), F.lit(0))).alias("n")).where("n > 0")

    buckets = counted(first, *own, "b")
    run = Window.partitionBy(*names).orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = buckets.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(Window.partitionBy(*names)))
    at = [F.lit(float(p)) * (F.col("all") - 1) for p in probs]
    ranks = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(e).alias("e"), (f(x).cast("long") + 1).alias("rank"), x.alias("at")) for p, x in zip(probs, at) for e, f in (("lo", F.floor), ("hi", F.ceil))]))
    marks = [f"w{i}" for i in range(len(names))]
    wanted = placed.withColumn("r", ranks).where("r.rank <= upto and r.rank > upto - n").select(*[F.col(n).alias(w) for n, w in zip(names, marks)], F.col("b").alias("wb"), F.col("r.p").alias("p"), F.col("r.e").alias("e"), (F.col("r.rank") - F.col("upto") + F.col("n")).alias("inner"), F.col("r.at").alias("at"))
    wanted = stored(wanted)
    small = wanted.count() <= BROADCAST_ROWS
    sized = lambda d: F.broadcast(d) if small else d.hint("merge")
    alike = lambda ns: reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(w)) for n, w in zip(ns, marks)] + [F.col("b") == F.col("wb")])
    same = alike(names)
    some = counted(again(wanted.select(*marks[: len(own)], "wb").distinct(), sized, alike(own)), *own, "b", "v")
    within = Window.partitionBy(*names, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = some.withColumn("upto", F.sum("n").over(within))
    hit = some.join(sized(wanted), same & (F.col("inner") <= F.col("upto")) & (F.col("inner") > F.col("upto") - F.col("n"))).select(*names, "p", "e", "at", "v")
    lo, hi = (F.max(F.when(F.col("e") == e, F.col("v"))) for e in ("lo", "hi"))
    out = hit.groupBy(*names, "p").agg(lo.alias("lo"), hi.alias("hi"), F.max("at").alias("at"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, by)], F.col("p").alias("prob"), (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("quantile"))


def _codes(v: np.ndarray) -> np.ndarray:
    """Buckets of finite doubles that follow their order: sign, exponent and 8 bits of the fraction."""
    bits = (v + 0.0).view(np.int64)  # -0.0 is 0.0
    return (bits ^ ((bits >> 63) & np.int64(2**63 - 1))) >> 44


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], without: tuple[str, Sequence[str]] | None = None) -> DataFrame:
    """(column_name, prob, quantile) of each column: what exact_quantiles gives of the columns' unpivoted values.

    Tasks count the buckets, then the values of the buckets wanted, of some rows in arrays; no row is made for a value.
    The buckets wanted are two for each column, probability and value of ``without``.
    """
    by = q(without[0]).cast("string") if without else F.lit("")
    flat = df.select(by.alias("o"), *[finite_or_null(q(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    if without:
        flat = flat.where("o is not null")
    names = list(columns)

    def counting(wanted: dict[str, list[int]] | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
            kept, n = [], 0
            for batch in batches:
                kept.append(batch)
                n += batch.num_rows
                if n >= CHUNK:
                    yield pa.Table.from_batches(kept)
                    kept, n = [], 0
            if n:
                yield pa.Table.from_batches(kept)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in chunks(batches):
                group = t.column(0).combine_chunks().dictionary_encode()
                place = group.indices.to_numpy()
                for i, name in enumerate(names):
                    v = t.column(i + 1).to_numpy().astype(float)
                    some = ~np.isnan(v)
                    v, at = v[some], place[some]
                    b = _codes(v)
                    if wanted is not None:
                        some = np.isin(b, wanted.get(name, []))
                        v, at, b = v[some] + 0.0, at[some], b[some]
                    for k, g in enumerate(group.dictionary.to_pylist()):
                        own = at == k
                        x, c = np.unique(b[own] if wanted is None else v[own], return_counts=True)
                        if not len(x):
                            continue
                        cells = {"g0": pa.array([name] * len(x), pa.string()), "o": pa.array([g] * len(x), pa.string()), "b": pa.array(x if wanted is None else _codes(x), pa.int64()), "c": pa.array(c, pa.int64())}
                        yield pa.RecordBatch.from_pydict(cells if wanted is None else cells | {"v": pa.array(x, pa.float64())})

        return run

    def again(wanted: DataFrame, *_: object) -> DataFrame:
        buckets: dict[str, list[int]] = {}
        for r in wanted.collect():
            buckets.setdefault(r["w0"], []).append(r["wb"])
        return flat.mapInArrow(counting(buckets), "g0 string, o string, b long, c long, v double")

    return _from_counts(flat.mapInArrow(counting(None), "g0 string, o string, b long, c long"), again, ["column_name"], ["g0"], probs, without)
