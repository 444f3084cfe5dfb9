"""Samples whose categories have target shares: calibration on the exponential-tilting dual and the pivotal method.

Per plan, every record starts with the same weight n / N and is tilted by exp(lambda of its category). The dual's
gradient needs one moment per category only, the number of its records, which one aggregation gives for all plans;
Newton's steps then run on these moments. Moments below a floor or above what there is are fixed there and the others
share the rest. The pivotal method draws with the resulting probabilities: records of a category fight in chunks of
bounded size, the one undecided record of each chunk goes on to its category, and the one of each category to its plan,
where the last one is drawn at random, so that sizes are exact up to rounding and no task holds a whole category.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.session import stored

#: Records of a category that fight in one task.
CHUNK = 20_000
# Characters that stand for a dash in labels.
DASHES = "–—�\u0096"


def normalized_label(c: Column) -> Column:
    """Trimmed, dash-like characters with the space around them as ' - ', white space collapsed, lower case."""
    t = F.regexp_replace(c, f"[\\s ]*[{DASHES}][\\s ]*", " - ")
    return F.lower(F.trim(F.regexp_replace(t, "[\\s ]+", " ")))


def calibrate(counts: np.ndarray, shares: np.ndarray, size: float, floors: np.ndarray, tol: float = 1e-12) -> tuple[np.ndarray, np.ndarray, int]:
    """(lambda, moment, Newton steps) of each category: records weigh size / sum(counts) * exp(lambda), at most 1.

    The dual is solved for the categories that are free: their moments, the expected sizes, shall have the given shares
    of what the fixed ones leave of size. Where a moment of the solution lies below its floor or above its records, the
    category is fixed there (floors or caps, whichever weigh more), and Newton's method goes on from the lambdas
    reached. Categories without records or share have moment 0 and lambda -inf unless their floor fixes them. Floors
    come before size: where all floors together are more than size, the sample is larger.
    """
    counts, shares = np.asarray(counts, float), np.maximum(np.asarray(shares, float), 0)
    floors = np.minimum(np.maximum(np.asarray(floors, float), 0), counts)
    base = counts * (size / counts.sum() if counts.sum() > 0 else 0)
    x = np.zeros(len(counts))
    fixed = np.full(len(counts), np.nan)
    fixed[(counts <= 0) | ((shares <= 0) & (floors <= 0))] = 0.0
    low = np.isnan(fixed) & (shares <= 0)
    fixed[low] = floors[low]
    steps = 0
    while True:
        free = np.isnan(fixed) & (base > 0)
        left = max(0.0, min(size, counts.sum()) - np.nansum(fixed))
        target = shares * (left / shares[free].sum()) if free.any() else shares
        moment = base * np.exp(x)
        while free.any() and steps < 10_000:
            steps += 1
            wanted = np.maximum(target[free], 1e-300)
            step = np.clip((moment[free] - wanted) / moment[free], -3, 3)  # disjoint categories: the Hessian holds the moments
            x[free] -= step
            moment = base * np.exp(x)
            if np.max(np.abs(step)) < tol or (left == 0 and moment[free].max() < 1e-9):
                break
        under, over = free & (moment < floors * (1 - 1e-12)), free & (moment > counts * (1 + 1e-12))
        if not (under | over).any():
            break
        if under.any() and (floors - moment)[under].sum() >= (moment - counts)[over].sum():
            fixed[under] = floors[under]
        else:
            fixed[over] = counts[over]
    moment = np.where(np.isnan(fixed), np.clip(moment, floors, counts), fixed)
    with np.errstate(divide="ignore", invalid="ignore"):
        lam = np.where((moment > 0) & (base > 0), np.log(moment / np.where(base > 0, base, 1)), -np.inf)
    return lam, moment, steps


REPORT = "plan_no long, group_key string, category string, target_share double, sample_rows double, min_rows double, available long, target double, tilt double, probability double, newton_steps int"


def calibrated_plans(records: DataFrame, plans: DataFrame) -> DataFrame:
    """Per row of plans: what there is, the calibrated size, and the records' probability.

    records: (group_key, category, ...), plans: (plan_no, group_key, category, target_share, sample_rows, min_rows).
    Records without a category take no part; a plan's null shares and sizes count as zero; equal plan rows stay.
    """
    counts = records.where("group_key is not null and category is not null").groupBy("group_key", "category").count()
    joined = plans.join(counts, ["group_key", "category"], "left").withColumn("available", F.coalesce("count", F.lit(0)))
    # the rows of a plan are as many as there are categories
    row = F.struct("group_key", "category", "target_share", "sample_rows", "min_rows", "available")
    per = joined.groupBy("plan_no").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def solve(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for plan, rows in zip(frame.plan_no, frame.rows):
                z = lambda c: np.array([float(r[c]) if r[c] is not None and r[c] == r[c] else 0.0 for r in rows])  # noqa: B023, E731
                share, n, floor, have = z("target_share"), z("sample_rows"), z("min_rows"), z("available")
                size = n.max() if len(n) else 0.0
                lam, target, steps = calibrate(have, share, size, floor)
                prob = np.minimum(1.0, np.divide(target, have, out=np.zeros(len(rows)), where=have > 0))
                out += [(plan, r["group_key"], r["category"], a, b, c, int(d), e, f if np.isfinite(f) else None, g, steps) for r, a, b, c, d, e, f, g in zip(rows, share, n, floor, have, target, lam, prob)]
            yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in REPORT.split(",")])

    return per.mapInPandas(solve, REPORT)


def fights(p: np.ndarray, group: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The pivotal method within runs of equal group: probabilities after all fights, all 0 or 1 but one a group.

    Undecided neighbours fight in pairs, all pairs at once, and what is left fights again. Of p and q one loses all
    if p + q < 1, else one is drawn and the other keeps p + q - 1; each has its own chance as expected value. The
    random number of a fight comes from the two seeds.
    """
    p = np.where(p >= 1 - 1e-9, 1.0, np.where(p <= 1e-9, 0.0, p))
    while True:
        at = np.flatnonzero((p > 0) & (p < 1))
        g = group[at]
        new = np.ones(len(at), bool)
        new[1:] = g[1:] != g[:-1]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)) if len(at) else at
        left = np.flatnonzero((np.arange(len(at)) - begin) % 2 == 0)
        left = left[left + 1 < len(at)]
        left = left[g[left + 1] == g[left]]
        if not len(left):
            return p
        a, b = at[left], at[left + 1]
        x = (seed[a].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (seed[b].view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)
        s = p[a] + p[b]
        over = s >= 1
        first = u * np.where(over, 2 - s, s) < np.where(over, 1 - p[b], p[a])  # a gains
        gain, lose = np.where(over, 1.0, s), np.where(over, s - 1, 0.0)
        p[a], p[b] = np.where(first, gain, lose), np.where(first, lose, gain)
        p[at] = np.where(p[at] >= 1 - 1e-9, 1.0, np.where(p[at] <= 1e-9, 0.0, p[at]))


def _pivotal(df: DataFrame, by: Sequence[str], final: bool) -> DataFrame:
    """Fights within each group of by, in the order of the records' hashes (rank).

    Keeps drawn records with p = 1 and at most one undecided record of each group; ``final`` draws that one by its
    own random number u.
    """
    names = df.columns

    def fight(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            p = fights(t.column("p").to_numpy(), runs(t), t.column("rank").to_numpy())
            if final:
                p = np.where((p > 0) & (p < 1), (t.column("u").to_numpy() < p).astype(float), p)
            keep = p > 0
            t = t.set_column(names.index("p"), "p", pa.array(p)).filter(pa.array(keep))
            yield from t.combine_chunks().to_batches()

        def runs(t: pa.Table) -> np.ndarray:
            new = np.zeros(t.num_rows, bool)
            for c in by:
                x = t.column(c).combine_chunks()
                x = x.chunk(0) if isinstance(x, pa.ChunkedArray) else x
                new[1:] |= pc.not_equal(x[1:], x[:-1]).fill_null(True).to_numpy(zero_copy_only=False)
            return np.cumsum(new)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
            g = runs(t)
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut:
                yield from settle(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None:
            yield from settle(held)

    return df.repartition(*by).sortWithinPartitions(*by, "rank", "id").mapInArrow(fight, df.schema)


def pivotal_sample(records: DataFrame, calibrated: DataFrame, *, seed: int = 7, chunk: int = CHUNK) -> DataFrame:
    """(plan_no, id, category, probability) of the records drawn; records: (id, group_key, category).

    Depends on ids and seed only, not on partitions. A record with several copies is drawn by each copy's own row;
    equal rows of a plan draw once.
    """
    cal = calibrated.where("probability > 0").select("plan_no", "group_key", "category", "available", F.col("probability").alias("pi")).dropDuplicates(["plan_no", "group_key", "category"])
    units = records.join(cal, ["group_key", "category"])
    h = F.xxhash64(F.lit(seed), "plan_no", "id")
    unit = lambda x: (F.shiftrightunsigned(x, 11).cast("double") / F.lit(float(1 << 53)))
    units = units.select(
        "plan_no", "category", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.greatest(F.lit(1), F.ceil(F.col("available") / chunk))).cast("int").alias("chunk"), "id", "pi", F.col("pi").alias("p"), h.alias("rank"), unit(F.xxhash64(F.lit(seed + 2), h)).alias("u")
    )
    first = stored(_pivotal(units, ["plan_no", "category", "chunk"], False))
    second = stored(_pivotal(first.where("p < 1"), ["plan_no", "category"], False))
    third = _pivotal(second.where("p < 1"), ["plan_no"], True)
    drawn = first.where("p = 1").unionByName(second.where("p = 1")).unionByName(third.where("p = 1"))
    return drawn.select("plan_no", "id", "category", F.col("pi").alias("probability"))


def sample_report(calibrated: DataFrame, drawn: DataFrame) -> DataFrame:
    """The calibrated plans with the rows drawn, the share reached of the plan's sample, the gap and whether it falls short.

    gap: rows wanted (``target_share * sample_rows``, at least min_rows) that were not drawn. short: there is a gap and
    the group has fewer records of the category than wanted; other gaps come from rounding or from the floors of others.
    """
    got = drawn.groupBy("plan_no", "category").agg(F.count("*").alias("drawn"))
    total = drawn.groupBy("plan_no").agg(F.count("*").alias("all_drawn"))
    out = calibrated.join(got, ["plan_no", "category"], "left").join(total, "plan_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    wanted = F.greatest(F.col("target_share") * F.col("sample_rows"), F.col("min_rows"))
    gap = F.greatest(wanted - F.col("drawn"), F.lit(0.0))
    return out.select(*calibrated.columns, "drawn", F.try_divide(F.col("drawn"), F.col("all_drawn")).alias("share_reached"), gap.alias("gap"), ((gap > 0) & (wanted > F.col("available"))).alias("short"))
