"""Queries that do the whole of their job: all features, models of the operators' own size."""

import os

import numpy as np
import pytest

from flowquarry.operators import correlation, iforest, models
from flowquarry.operators.features import Preprocessor
from flowquarry.plans import core, modelqueries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_all_pairs_of_features(spark):
    got = {(r["column_a"], r["column_b"]) for r in core.QUERIES["correlated_pairs_all"](spark, SF).collect()}
    assert {("Total Fwd Packets", "Total Backward Packets"), ("Flow Duration", "Fwd IAT Total"), ("Total Fwd Packets", "Fwd Header Length")} <= got
    assert {(r["column_a"], r["column_b"]) for r in core.QUERIES["correlated_pairs"](spark, SF).collect()} <= got


def test_pairs_without_spread(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 5.0, float(i) if i < 40 else None) for i in range(50)], "a double, b double, c double, d double")
    got = {(r["column_a"], r["column_b"]): (r["r"], r["n"]) for r in correlation.correlations(df, ["a", "b", "c", "d"]).collect()}
    assert got["a", "b"] == (pytest.approx(1.0), 50) and got["a", "d"] == (pytest.approx(1.0), 40)
    assert got["a", "c"] == (None, 50) and got["c", "d"] == (None, 40)


def test_pairs_of_large_means_over_batches_and_of_no_rows(spark):
    df = spark.range(50_000).repartition(7).selectExpr("1e9 + id % 97 as a", "1e9 - id % 97 + id % 2 as b")
    (row,) = correlation.correlations(df, ["a", "b"]).collect()
    k = np.arange(50_000)
    assert row["n"] == 50_000 and row["r"] == pytest.approx(np.corrcoef(k % 97, -(k % 97) + k % 2)[0, 1], abs=1e-9)
    assert [tuple(r) for r in correlation.correlations(df.where("a < 0"), ["a", "b"]).collect()] == [("a", "b", None, 0)]


class Guess:
    """In place of an estimator: nothing is trained."""

    def fit(self, vectors):
        return 0.5


@pytest.mark.parametrize("name", ["random_forest_scores", "model_comparison", "leave_one_family_out", "held_out_friday", "isolation_forest_scores", "port_ablation", "detector_scores"])
def test_models_have_the_operators_own_size(name, spark, monkeypatch):
    forests, isolation = set(), set()

    def estimator(spec, seed=42, trees=100, depth=12):
        forests.add((trees, depth))
        return Guess()

    def isolate(df, features, key, *, trees=200, sample=256, seed=42):
        isolation.add((trees, sample))
        return iforest.IsolationForest(features, [np.array([[-1, 0, -1, -1, 1.0]])], sample)

    def prepared(train, columns, **how):
        return Preprocessor(list(columns), list(columns), medians=dict.fromkeys(columns, 0.0))

    monkeypatch.setattr(models, "estimator", estimator)
    monkeypatch.setattr(iforest, "fit_isolation_forest", isolate)
    monkeypatch.setattr(models, "fit_preprocessor", prepared)
    monkeypatch.setattr(modelqueries, "fit_preprocessor", prepared)
    core.QUERIES[name](spark, SF)
    assert forests or isolation
    assert forests <= {(100, 12)} and isolation <= {(200, 256)}
