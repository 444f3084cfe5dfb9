"""Exact path-dependent Shapley values of tree ensembles, and the tables built from them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.operators.forest import ForestModel


class Tree:
    """A binary tree: feature (-1 for a leaf), threshold (left if x <= threshold), children, value and cover."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray, value: np.ndarray, cover: np.ndarray):
        self.feature, self.threshold, self.left, self.right, self.value, self.cover = feature, threshold, left, right, value, cover

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while (self.feature[at] >= 0).any():
            f = self.feature[at]
            go = x[np.arange(len(x)), np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(f >= 0, np.where(go, self.left[at], self.right[at]), at)
        return self.value[at]

    def expected(self) -> float:
        leaf = self.feature < 0
        return float((self.value[leaf] * self.cover[leaf]).sum() / self.cover[leaf].sum())


class _Level:
    """The inner nodes of one level: first those of which only the left child is an inner node, then both, only the right one, none.

    low and high bound the feature of the node on its path, share is the part of the cover that follows these bounds,
    part the left child's of the node's cover. left and right are the slices of nodes with such children; leaves have values.
    """

    def __init__(self, tree: Tree, nodes: np.ndarray, low: np.ndarray, high: np.ndarray, share: np.ndarray):
        inner = [tree.feature[c[nodes]] >= 0 for c in (tree.left, tree.right)]
        kind = np.where(inner[0], np.where(inner[1], 1, 0), np.where(inner[1], 2, 3))
        self.order = np.argsort(kind, kind="stable")  # of the nodes as they came
        self.back = np.argsort(self.order)
        a, b, c = np.bincount(kind, minlength=4)[:3].cumsum()
        self.left, self.right, self.some = slice(0, b), slice(a, c), slice(0, c)
        self.right_leaves = slice(0, a), slice(c, len(nodes))
        nodes, every = nodes[self.order], np.arange(len(nodes))
        self.feature, self.cut = tree.feature[nodes], tree.threshold[nodes]
        self.low, self.high, self.share = (x[self.order, self.feature] for x in (low, high, share))
        left, right = tree.left[nodes], tree.right[nodes]
        self.part = tree.cover[left] / tree.cover[nodes]
        self.left_value, self.right_value = tree.value[left][:, None], tree.value[right][:, None]
        self.parents = np.concatenate([every[self.left], every[self.right]])  # of children that are inner nodes
        self.children = np.concatenate([left[self.left], right[self.right]])


def _levels(tree: Tree, features: int) -> list[_Level]:
    out = []
    nodes = np.zeros(1, int) if tree.feature[0] >= 0 else np.zeros(0, int)
    low, high, share = np.full((1, features), -np.inf), np.full((1, features), np.inf), np.ones((1, features))
    while len(nodes):
        v = _Level(tree, nodes, low, high, share)
        out.append(v)
        low, high, share = (x[v.order[v.parents]] for x in (low, high, share))
        own, f, n = np.arange(len(v.parents)), v.feature[v.parents], v.left.stop
        high[own[:n], f[:n]] = np.minimum(v.high, v.cut)[v.left]
        low[own[n:], f[n:]] = np.maximum(v.low, v.cut)[v.right]
        share[own, f] *= np.concatenate([v.part[v.left], 1 - v.part[v.right]])
        nodes = v.children
    return out


def shap_values(trees: Sequence[Tree], x: np.ndarray) -> tuple[np.ndarray, float]:
    """Shapley values (rows x features) of the trees' mean prediction, and the base value.

    For a leaf the game is value * product over the features of its path of (1 if the row follows the path there, else
    the share of cover). A coalition's weight in a Shapley value is the integral of t ** size * (1 - t) ** (others) over
    0 to 1, so the value of feature j is value * (own - share) * the integral of the product over the other features of
    (t * own + (1 - t) * share): a polynomial of t, which Gauss-Legendre quadrature integrates exactly with half as many
    points as the path has features.

    At a point t, a node splits its product between its children: the left one gets a part that depends on the node and
    on whether the row follows the path there so far, and then goes left or right; the right one gets the rest. So
    products are passed down, mean values of what is below passed up, and a node adds product * (left mean - right mean)
    * a factor of the same cases to its feature. Each step takes all nodes of a level and a block of rows together.
    """
    n, m = x.shape
    phi = np.zeros((n, m))
    base = 0.0
    columns = np.ascontiguousarray(x.T)
    for tree in trees:
        base += tree.expected()
        levels = _levels(tree, m)
        if not levels:
            continue
        t, w = np.polynomial.legendre.leggauss(-(-min(m, len(levels)) // 2))  # a path has no more features
        t, w = (t + 1) / 2, w / 2
        tables = []  # per point and level: the left child's part and the factor, per node and case (off the path, right, left)
        for u, by in zip(t, w):
            tables.append([])
            for v in levels:
                on = u + (1 - u) * v.share
                part = np.stack([v.part, (1 - u) * v.share * v.part / on, (u + (1 - u) * v.share * v.part) / on], 1)
                factor = by / ((1 - u) * on)[:, None] * np.stack([np.zeros_like(on), -part[:, 1], 1 - part[:, 2]], 1)
                tables[-1].append((part.ravel(), factor.ravel()))
        sums = [(v.feature == np.arange(m)[:, None]).astype(float) for v in levels]
        step = max(16, 40_000 // max(len(v.feature) for v in levels))
        for start in range(0, n, step):
            block = columns[:, start : start + step]
            cases, added = [], []
            for v in levels:
                own = block[v.feature]
                case = (own <= v.cut[:, None]).astype(np.intp)
                case += 1
                case *= (own > v.low[:, None]) & (own <= v.high[:, None])
                case += 3 * np.arange(len(v.feature))[:, None]
                cases.append(case)
                added.append(np.zeros(own.shape))
            for point in tables:
                product, products, parts = np.ones(cases[0].shape), [], []
                for v, case, (part, _) in zip(levels, cases, point):
                    product = product.take(v.order, 0)
                    products.append(product)
                    parts.append(part.take(case))
                    left = product[v.some] * parts[-1][v.some]
                    product = np.concatenate([left[v.left], product[v.right] - left[v.right]])
                below = product  # of no nodes
                for v, case, (_, factor), mean, product, add in zip(levels[::-1], cases[::-1], point[::-1], parts[::-1], products[::-1], added[::-1]):
                    first = v.left.stop
                    gap = np.empty(mean.shape)
                    gap[:first], gap[first:] = below[:first], v.left_value[first:]
                    gap[v.right] -= below[first:]
                    for leaves in v.right_leaves:
                        gap[leaves] -= v.right_value[leaves]
                    mean *= gap
                    mean[v.right] += below[first:]
                    for leaves in v.right_leaves:
                        mean[leaves] += v.right_value[leaves]
                    gap *= product
                    gap *= factor.take(case)
                    add += gap
                    below = mean.take(v.back, 0)
            for s, add in zip(sums, added):
                phi[start : start + step] += (s @ add).T
    return phi / len(trees), base / len(trees)


def trees_of(model: ForestModel | RandomForestClassificationModel) -> list[Tree]:
    """The trees of a fitted forest of two classes, with the share of class 1 as leaf value."""
    out = []
    if isinstance(model, ForestModel):
        for nodes in model.trees:
            f, cut, left = nodes[:, :3].astype(int).T
            threshold = np.array([model.cuts[a][b] if a >= 0 else 0.0 for a, b in zip(f, cut)])
            cover = nodes[:, 3] + nodes[:, 4]
            out.append(Tree(f, threshold, left, np.where(f >= 0, left + 1, -1), nodes[:, 4] / cover, cover))
        return out
    for t in model.trees:
        rows: list[list[float]] = []

        def add(node: object) -> int:
            at = len(rows)
            stats = node.impurityStats()
            counts = list(stats.stats())
            rows.append([-1, 0.0, -1, -1, counts[1] / max(sum(counts), 1e-300), sum(counts)])
            if node.subtreeDepth() > 0:
                split = node.split()
                rows[at][:2] = [split.featureIndex(), split.threshold()]
                rows[at][2] = add(node.leftChild())
                rows[at][3] = add(node.rightChild())
            return at

        add(t._call_java("rootNode"))
        a = np.array(rows, float)
        out.append(Tree(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], a[:, 5]))
    return out


def explained(df: DataFrame, vector: str, keep: Sequence[str], names: Sequence[str], trees: Sequence[Tree]) -> DataFrame:
    """(keep..., p, base, contributions array<struct<feature, value, shap>>) for each row.

    Rows are few and each takes long: they are dealt to as many tasks as run at once, as each task lays out all trees.
    """
    spark: SparkSession = df.sparkSession
    parts = [(t.feature, t.threshold, t.left, t.right, t.value, t.cover) for t in trees]  # plain arrays, which need no package to be read
    shared = spark.sparkContext.broadcast((parts, list(names)))  # the model, whose size its depth bounds
    types = dict(df.dtypes)
    rows = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)], F.col(vector).alias("x")).repartition(spark.sparkContext.defaultParallelism)
    schema = ", ".join([*(f"k{i} {types[k]}" for i, k in enumerate(keep)), "p double, base double, contributions array<struct<feature: string, value: double, shap: double>>"])

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, features = [Tree(*p) for p in shared.value[0]], shared.value[1]
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame.x.to_numpy())
            phi, base = shap_values(model, x)
            p = np.mean([t.predict(x) for t in model], axis=0)
            items = [[{"feature": f, "value": float(v), "shap": float(s)} for f, v, s in zip(features, xs, ps)] for xs, ps in zip(x, phi)]
            yield frame.drop(columns="x").assign(p=p, base=base, contributions=items)

    out = rows.mapInPandas(run, schema)
    for i, k in enumerate(keep):
        out = out.withColumnRenamed(f"k{i}", k)
    return out


def importance(contributions: DataFrame, by: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """Mean |shap| per feature (and group), the greatest first; with ``most`` only as many rows."""
    long = contributions.select(*by, F.explode("contributions").alias("c"))
    got = long.groupBy(*by, F.col("c.feature").alias("feature")).agg(F.avg(F.abs("c.shap")).alias("mean_abs_shap")).orderBy(F.desc("mean_abs_shap"), *by, "feature")
    return got if most is None else got.limit(most)
