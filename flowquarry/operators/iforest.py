"""Isolation forest: trees over small random samples, scores from path lengths."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.scalars import q


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points: 0 for one, 1 for two."""
    n = np.asarray(n, float)
    big = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, big))


def grow(x: np.ndarray, rng: np.random.Generator, height: int) -> np.ndarray:
    """Nodes (feature, cut, left, right, value): a leaf has feature -1 and its path length as value."""
    nodes: list[list[float]] = []

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, -1, -1, depth + float(average_path(len(rows)))])
        if depth >= height or len(rows) <= 1:
            return at
        lo, hi = x[rows].min(0), x[rows].max(0)
        open_ = np.flatnonzero(hi > lo)
        if not len(open_):
            return at
        f = int(rng.choice(open_))
        cut = float(rng.uniform(lo[f], hi[f]))
        mask = x[rows, f] < cut
        left = build(rows[mask], depth + 1)
        right = build(rows[~mask], depth + 1)
        nodes[at] = [f, cut, left, right, 0.0]
        return at

    build(np.arange(len(x)), 0)
    return np.array(nodes)


class IsolationForest:
    """Fitted trees; scores lie in (0, 1], higher for rows that are easier to isolate."""

    def __init__(self, features: Sequence[str], trees: list[np.ndarray], sample: int):
        self.features, self.trees, self.sample = list(features), trees, sample

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            feature = t[:, 0].astype(int)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                left = x[np.arange(len(x)), np.maximum(f, 0)] < t[at, 1]
                at = np.where(inner, np.where(left, t[at, 2], t[at, 3]).astype(np.int64), at)
            total += t[at, 4]
        return total / len(self.trees)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 2.0 ** (-self.path_lengths(x) / max(float(average_path(self.sample)), 1e-12))

    def transform(self, df: DataFrame, name: str = "anomaly_score") -> DataFrame:
        """df with the score; features must be finite (impute before)."""
        model = df.sparkSession.sparkContext.broadcast(self)  # trees * 2 * sample nodes, whatever the size of df

        @F.pandas_udf("double")
        def score(*cols: pd.Series) -> pd.Series:
            return pd.Series(model.value.score(np.column_stack([c.to_numpy(float) for c in cols])))

        return df.withColumn(name, score(*[q(c) for c in self.features]))


def fit_isolation_forest(df: DataFrame, features: Sequence[str], key: str, *, trees: int = 200, sample: int = 256, seed: int = 42) -> IsolationForest:
    """Each tree grows on the rows with the smallest hashes of (seed, tree, key): the trees don't depend on partitions.

    The rows of all trees together are at most trees * sample; only they leave the scan, as each partition keeps its
    smallest hashes of a tree before the shuffle. Fewer rows than sample: all of them.
    """
    x = F.array(*[q(c).cast("double") for c in features])
    share = df.count()
    if share == 0:
        raise ValueError("no rows to fit on")
    # a row competes for the trees for which its hash is low enough; the bound leaves four times the rows needed
    bound = min(1.0, 4.0 * sample / share + 40.0 / share)
    h = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, F.col("k")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    tree = F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: h(t) <= bound)).alias("tree")
    rows = df.select(x.alias("x"), q(key).alias("k")).select("x", "k", tree).withColumn("h", h(F.col("tree")))
    kept = rows.withColumn("rn", F.row_number().over(Window.partitionBy("tree").orderBy("h", "k"))).where(F.col("rn") <= sample)
    height = max(1, math.ceil(math.log2(max(2, min(sample, share)))))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        t = int(frame.tree.iloc[0])
        frame = frame.sort_values("rn")
        nodes = grow(np.stack(frame.x.to_numpy()), np.random.default_rng([seed, t]), height)
        return pd.DataFrame({"tree": [t], "n": [len(frame)], "nodes": [nodes.ravel().tolist()]})

    grown = kept.groupBy("tree").applyInPandas(one, "tree int, n int, nodes array<double>").orderBy("tree").collect()
    return IsolationForest(features, [np.array(r["nodes"]).reshape(-1, 5) for r in grown], max(r["n"] for r in grown))
