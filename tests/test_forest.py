"""The forest and its explanations at the size that the queries use, in bounded time."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.operators import explain, forest, models

K = 12


def flows(rows, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, K)), 2)
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + rng.normal(size=rows) > 0.5).astype(np.uint8)
    return x, y


def grown(x, y, trees, depth, bins=64):
    cuts = [forest.cuts_of(c, bins) for c in x.T]
    codes = forest.codes_of(list(x.T), cuts).ravel()
    return forest.ForestModel(cuts, [forest.grow(lambda: [(codes, y)], x.shape[1], bins, 4, depth, 7, t) for t in range(trees)])


@pytest.fixture(scope="module")
def table(spark):
    x, y = flows(6000)
    return spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y))], "id long, " + ", ".join(f"c{i} double" for i in range(K)) + ", y int").repartition(3).cache()


COLUMNS = [f"c{i}" for i in range(K)]


def test_contributions_of_a_whole_forest_take_seconds():
    x, y = flows(8000)
    trees = explain.trees_of(grown(x, y, 10, 12))
    assert np.mean([(t.feature < 0).sum() for t in trees]) > 300
    some = x[:100]
    began = time.monotonic()
    phi, base = explain.shap_values(trees, some)
    assert time.monotonic() - began < 10  # a leaf at a time, with a polynomial per feature: over a minute
    assert np.abs(base + phi.sum(1) - np.mean([t.predict(some) for t in trees], 0)).max() < 1e-9


def test_contributions_don_t_fetch_nodes_one_by_one(spark, table):
    m = models.fit(table.where("id < 4000"), COLUMNS, F.col("y"), trees=20, depth=12)
    began = time.monotonic()
    trees = explain.trees_of(m.model)
    assert time.monotonic() - began < 2 and len(trees) == 20
    assert np.mean([len(t.feature) for t in trees]) > 500


def test_explained_rows_are_dealt_to_tasks(spark, table):
    m = models.fit(table.where("id < 500"), COLUMNS, F.col("y"), trees=3, depth=3)
    vec = m.vectors(table.where("id < 40").coalesce(1), ["id"]).withColumn("v", models.vector_to_array("__x"))
    got = explain.explained(vec, "v", ["id"], m.prep.kept, explain.trees_of(m.model)).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 40 and len({r["task"] for r in got}) > 3
    want = np.mean(np.abs([[c["shap"] for c in r["contributions"]] for r in got]), 0)
    found = {r["feature"]: r["mean_abs_shap"] for r in explain.importance(explain.explained(vec, "v", ["id"], m.prep.kept, explain.trees_of(m.model))).collect()}
    assert [found[f] for f in m.prep.kept] == pytest.approx(want)


def test_preprocessing_without_each_group_is_what_its_rows_alone_give(spark):
    from flowquarry.operators import features

    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        g = "abc"[i % 3] if i % 50 else None
        a = float(np.round(rng.normal(), 1))
        # e differs from a in group b only, d varies in group c only; f has gaps
        rows.append((g, a, -a, a + (g == "b"), 5.0 + i * (g == "c"), [None, float("nan"), float("inf"), a * 3][i % 4], None))
    df = spark.createDataFrame(rows, "g string, a double, b double, e double, d double, f double, n double").repartition(3)
    columns = ["a", "b", "e", "d", "f", "n"]
    got = features.fit_preprocessors_without(df, columns, "g", ["a", "b", "c"], exclude=("b",))
    for g in "abc":
        assert got[g] == features.fit_preprocessor(df.where(F.col("g") != g), columns, exclude=("b",))
    assert got["b"].duplicate_of == {"e": "a"} and got["c"].constant == ["d", "n"] and got["a"].duplicate_of == {}


def test_leaving_families_out_takes_the_preprocessing_from_one_pass(spark, table, monkeypatch):
    monkeypatch.setattr(models, "fit_preprocessor", lambda *a, **k: pytest.fail("one preprocessing per family"))
    df = table.withColumn("fam", F.concat(F.lit("f"), F.col("id") % 3))
    got = models.leave_one_out(df.where("id < 300"), df.where("id >= 5900"), "fam", COLUMNS, F.col("y"), "f0", ["id"], trees=2, depth=2)
    assert {(r["held"], r["count"]) for r in got.groupBy("held").count().collect()} == {("f1", 100), ("f2", 100)}


def test_comparison_scores_each_row_once_and_shares_the_preprocessing(spark, table, monkeypatch):
    from flowquarry.operators import detector

    scored, learned = spark.sparkContext.accumulator(0), []
    score, learn = models.Scorer.score, models.fit_preprocessor

    def counted(self, df, keep, name="p"):
        def seen(p):
            scored.add(1)
            return p

        return score(self, df, keep, name).withColumn(name, F.udf(seen, "double")(name))

    monkeypatch.setattr(models.Scorer, "score", counted)
    monkeypatch.setattr(models, "fit_preprocessor", lambda *a, **k: learned.append(1) or learn(*a, **k))
    df = table.withColumn("label", F.when(F.col("y") == 1, "DoS").when(F.col("id") % 2 == 0, "BENIGN"))
    got, by_label, best, _ = detector.compare(df.where("id < 300"), df.where("id between 300 and 399"), df.where("id between 400 and 549"), COLUMNS, F.col("y"), "label", specs=("majority_class", "random_forest"), trees=3, depth=3)
    assert len(got.collect()) == 4 and best == "random_forest"
    assert {r["label"] for r in by_label.collect()} == {"DoS", "BENIGN", None} and by_label.agg(F.sum("row_count")).first()[0] == 150
    assert scored.value == 2 * (100 + 150) and learned == [1]


def test_a_forest_of_the_operators_size_takes_seconds_and_is_the_same_from_held_and_reread_blocks(spark, table, monkeypatch):
    train = table.where("id < 5000").coalesce(2).cache()
    models.fit(train, COLUMNS, F.col("y"), trees=2, depth=2)  # starts the workers
    began = time.monotonic()
    a = models.fit(train, COLUMNS, F.col("y")).model
    assert time.monotonic() - began < 30 and len(a.trees) == 100  # on histograms sent through shuffles: some minutes
    monkeypatch.setattr(forest, "HELD", 0)
    b = models.fit(train, COLUMNS, F.col("y")).model
    assert all(np.array_equal(s, t) for s, t in zip(a.trees, b.trees))
    x, y = flows(6000)
    p = a.score(list(x[5000:].T))
    assert ((p >= 0.5) == y[5000:]).mean() > 0.7
    for t in a.trees[:3]:  # children share the rows of their node
        inner = np.flatnonzero(t[:, 0] >= 0)
        left = t[inner, 2].astype(int)
        assert np.array_equal(t[inner, 3:], t[left, 3:] + t[left + 1, 3:]) and (t[:, 3:].sum(1) > 0).all()


def test_few_rows_and_wrong_truth(spark, table):
    one = models.fit(table.where("id = 1"), COLUMNS, F.col("y"), trees=3, depth=3)
    assert [r["p"] for r in one.score(table.where("id < 3"), ["id"]).collect()] == [float(table.where("id = 1").first()["y"])] * 3
    for bad, why in ((F.lit(None), "truth"), (F.lit(2), "truth")):
        with pytest.raises(Exception, match=why):
            models.fit(table.where("id < 9"), COLUMNS, bad, trees=1, depth=1)
    with pytest.raises(ValueError, match="no rows"):
        models.fit(table.where("id < 0"), COLUMNS, F.col("y"), trees=1, depth=1)


def test_rates_by_label_are_those_of_the_stored_scores(spark, table, monkeypatch):
    from flowquarry.operators import detector

    kept, stored = [], detector.stored
    monkeypatch.setattr(detector, "stored", lambda d: kept.append(stored(d)) or kept[-1])
    df = table.withColumn("label", F.concat(F.lit("l"), F.col("id") % 4))
    by_label = detector.compare(df.where("id < 200"), df.where("id between 200 and 249"), df.where("id between 300 and 499"), COLUMNS, F.col("y"), "label", specs=("majority_class", "random_forest"), trees=3, depth=3)[1]
    want = kept[-1].groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("p") >= 0.5).cast("double")).alias("r"))
    got = {r["label"]: (r["row_count"], r["random_forest"]) for r in by_label.collect()}
    assert len(kept) == 4 and got == {r["label"]: (r["n"], pytest.approx(r["r"])) for r in want.collect()} and len(got) == 4


def test_families_beside_anomalies_share_one_preprocessing(spark, monkeypatch):
    import os

    from flowquarry.operators import iforest
    from flowquarry.plans import core

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")

    class Guess:
        def fit(self, vectors):
            return 0.5

    monkeypatch.setattr(models, "fit_preprocessor", lambda *a, **k: pytest.fail("one preprocessing per family"))
    monkeypatch.setattr(models, "estimator", lambda *a, **k: Guess())
    monkeypatch.setattr(iforest, "fit_isolation_forest", lambda df, features, key, **k: iforest.IsolationForest(features, [np.array([[-1, 0, -1, -1, 1.0]])], 256))
    got = core.QUERIES["leave_one_family_out_with_anomalies"](spark, sf).collect()
    assert len(got) > 1 and {r["forest_fpr"] for r in got} == {1.0}


def test_contributions_are_shapley_values_where_features_come_again_on_a_path():
    import itertools
    import math

    x, y = flows(3000)
    x = x[:, :4]
    trees = explain.trees_of(grown(x, y, 3, 7))
    assert any((t.feature >= 0).sum() > 20 for t in trees)  # more nodes on a path than features

    def expected(t, row, known, at=0):
        f = t.feature[at]
        if f < 0:
            return t.value[at]
        if f in known:
            return expected(t, row, known, t.left[at] if row[f] <= t.threshold[at] else t.right[at])
        return sum(t.cover[c] / t.cover[at] * expected(t, row, known, c) for c in (t.left[at], t.right[at]))

    some = x[:5]
    phi, base = explain.shap_values(trees, some)
    for row, got in zip(some, phi):
        for j in range(4):
            want = 0.0
            for s in (s for n in range(4) for s in itertools.combinations({0, 1, 2, 3} - {j}, n)):
                weight = math.factorial(len(s)) * math.factorial(3 - len(s)) / 24
                want += weight * np.mean([expected(t, row, {*s, j}) - expected(t, row, set(s)) for t in trees])
            assert got[j] == pytest.approx(want, abs=1e-12)
    assert base == pytest.approx(np.mean([expected(t, some[0], set()) for t in trees]))


def test_rows_in_several_blocks_get_what_they_get_alone():
    x, y = flows(3000)
    trees = explain.trees_of(grown(x, y, 3, 10))
    many = np.tile(x[:40], (60, 1))
    phi, _ = explain.shap_values(trees, many)
    assert np.abs(phi - np.tile(explain.shap_values(trees, x[:40])[0], (60, 1))).max() < 1e-12
    assert explain.shap_values(trees, x[:0])[0].shape == (0, K)


def test_trees_are_laid_out_once_for_each_task_that_runs(spark, table):
    m = models.fit(table.where("id < 500"), COLUMNS, F.col("y"), trees=3, depth=3)
    vec = m.vectors(table.where("id < 400"), ["id"]).withColumn("v", models.vector_to_array("__x"))
    got = explain.explained(vec, "v", ["id"], m.prep.kept, explain.trees_of(m.model))
    assert got.select(F.spark_partition_id().alias("t")).distinct().count() == spark.sparkContext.defaultParallelism  # before: three times as many


@pytest.mark.parametrize("without", [None, ("g", ["a", "b", "none"])])
def test_quantiles_of_columns_are_those_of_their_unpivoted_values(spark, without, monkeypatch):
    from flowquarry.operators import orderstats, profile

    rng = np.random.default_rng(5)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 5e-324, -1e308, 1e308]
    rows = [("abc"[i % 3] if i % 40 else None, float(np.round(rng.normal(), 2)), odd[i % 9], float(i % 7), None, -float(10.0 ** rng.integers(-9, 9))) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, `a b` double, odd double, few double, none double, wide double").repartition(3).cache()
    columns, probs = df.columns[1:], [0.0, 0.25, 0.5, 0.9, 1.0]
    keep = [F.col("g")] if without else []
    want = orderstats.exact_quantiles(profile.unpivoted(df, columns, keep), ["column_name"], "value", probs, without=without).collect()
    plans = []
    stored = orderstats.stored
    monkeypatch.setattr(orderstats, "stored", lambda d: plans.append(d._jdf.queryExecution().toString()) or stored(d))
    monkeypatch.setattr(orderstats, "CHUNK", 100)
    got = orderstats.column_quantiles(df, columns, probs, without=without)
    assert len(want) > 15 and sorted(map(str, got.collect())) == sorted(map(str, want)) and got.columns[0] == "column_name"
    assert plans and not any("Expand" in p for p in plans)  # no row per cell


def test_forests_without_each_family_are_those_of_the_other_rows_alone_and_share_their_passes(spark, table, monkeypatch):
    written, stored = [], forest.stored
    monkeypatch.setattr(forest, "stored", lambda *a: written.append(1) or stored(*a))
    df = table.withColumn("fam", F.when(F.col("id") % 50 > 0, F.concat(F.lit("f"), F.col("id") % 4)))
    df = df.withColumn("c3", F.when(F.col("id") % 7 > 0, F.col("c3"))).withColumn("c5", F.when(F.col("fam") == "f2", F.col("c5")).otherwise(1.0))  # c5 goes without f2
    df = df.withColumn("c7", F.when(F.col("id") % 9 > 0, F.col("c7")).otherwise(float("inf"))).cache()
    train, test = df.where("id < 3000"), df.where("id >= 5900")
    got = models.leave_one_out(train, test, "fam", COLUMNS, F.col("y"), "f0", ["id"], trees=3, depth=6).collect()
    assert written == [1]  # before: a table for each family
    for g in ("f1", "f2", "f3"):
        alone = models.fit(train.where(F.col("fam") != g), COLUMNS, F.col("y"), trees=3, depth=6)
        assert ("c5" in alone.prep.kept) == (g != "f2")
        assert {r["id"]: r["p"] for r in got if r["held"] == g} == {r["id"]: r["p"] for r in alone.score(test, ["id"]).collect()}
    monkeypatch.setattr(forest, "CUT_ROWS", 500)  # cuts from some rows
    some = models.leave_one_out(train, test, "fam", COLUMNS, F.col("y"), "f0", ["id", "y"], trees=20, depth=6)
    assert some.agg(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double"))).first()[0] > 0.65
    with pytest.raises(Exception, match="truth"):
        models.leave_one_out(train, test, "fam", COLUMNS, F.lit(None), "f0", ["id"], trees=1, depth=1)


def test_preprocessing_of_all_rows_comes_with_that_without_each_group(spark, table):
    from flowquarry.operators import features

    df = table.where("id < 600").withColumn("fam", F.concat(F.lit("f"), F.col("id") % 3))
    got = features.fit_preprocessors_without(df, COLUMNS, "fam", ["f1", "no family"])
    assert got["no family"] == features.fit_preprocessor(df, COLUMNS) and got["f1"] == features.fit_preprocessor(df.where("fam <> 'f1'"), COLUMNS)


def test_rates_by_label_alone_need_no_stored_scores_and_are_those_of_the_comparison(spark, table, monkeypatch):
    from flowquarry.operators import detector

    df = table.withColumn("label", F.when(F.col("id") % 5 > 0, F.concat(F.lit("l"), F.col("id") % 4)))
    train, val, test = df.where("id < 200"), df.where("id between 200 and 249"), df.where("id between 300 and 499")
    specs = ("majority_class", "logistic_regression", "decision_tree", "random_forest")
    want = detector.compare(train, val, test, COLUMNS, F.col("y"), "label", specs=specs, trees=3, depth=3)[1]
    monkeypatch.setattr(detector, "stored", lambda d: pytest.fail("scores of a split stored"))
    got = detector.label_rates(train, test, COLUMNS, F.col("y"), "label", specs=specs, trees=3, depth=3)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 5
