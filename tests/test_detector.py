"""Saved and loaded models, predictions for files, and what a scoring service does."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowquarry.operators import detector, models, requests
from flowquarry.operators.features import SchemaError

COLUMNS = ["Flow Duration", "Flow Bytes/s", "Destination Port"]
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def flows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 3))
    y = (x[:, 0] + 0.2 * x[:, 1] > 0).astype(int)
    return spark.createDataFrame([(i, float(a), float(b), float(c), int(k), "Bot" if k and i % 5 == 0 else "DDoS" if k else "BENIGN") for i, ((a, b, c), k) in enumerate(zip(x, y))], "id long, `Flow Duration` double, `Flow Bytes/s` double, `Destination Port` double, y int, label string").cache()


@pytest.fixture(scope="module")
def fitted(flows):
    return detector.fit_detector(flows.where("id < 400"), flows.where("id between 400 and 549"), COLUMNS, F.col("y"), "id", target_fpr=0.1, anomaly_trees=20, trees=8, depth=5)


def test_detector_saved_and_loaded(spark, flows, fitted, tmp_path):
    test = flows.where("id >= 550")
    fitted.save(spark, str(tmp_path / "d"))
    fitted.save(spark, str(tmp_path / "d"))  # replaces
    again = detector.Detector.load(spark, str(tmp_path / "d"))
    a, b = (d.score(test, ["id", "y"], "id").orderBy("id").collect() for d in (fitted, again))
    assert a == b and len(a) == 150
    for r in a:
        assert r["decision"] == ("known_attack" if r["p"] >= 0.5 else "anomaly" if r["anomaly_score"] >= fitted.threshold else "benign")
    assert again.info() == fitted.info() and again.info()["features"] == COLUMNS and again.info()["excluded"] == ["Destination Port"] and again.info()["features_used_count"] == 2
    benign = fitted.score(flows.where("id between 400 and 549 and y = 0"), ["id"], "id").toPandas()
    assert abs((benign.anomaly_score >= fitted.threshold).mean() - 0.1) < 0.03


@pytest.mark.parametrize("spec", ["majority_class", "logistic_regression", "decision_tree", "gradient_boosting"])
def test_scorers_saved_and_loaded(spark, flows, spec, tmp_path):
    s = models.fit(flows.where("id < 200"), COLUMNS, F.col("y"), spec)
    detector.save_scorer(spark, s, str(tmp_path / spec))
    got = detector.load_scorer(spark, str(tmp_path / spec)).score(flows.where("id >= 600"), ["id"]).orderBy("id").collect()
    assert got == s.score(flows.where("id >= 600"), ["id"]).orderBy("id").collect()


def test_prediction_of_files(spark, flows, fitted, tmp_path):
    (tmp_path / "in.csv").write_text(" Flow Duration, Flow Bytes/s , Destination Port, note\n1.5,2,80,a\nabc,Infinity,80,b\n-3,,22,c\n")
    got = detector.predict_csv(spark, str(tmp_path / "in.csv"), fitted.scorer, str(tmp_path / "out")).collect()
    assert [r["note"] for r in got] == ["a", "b", "c"] and [r["prediction"] for r in got] == ["attack" if r["attack_probability"] >= 0.5 else "benign" for r in got]
    assert got[0]["prediction"] == "attack" and got[2]["prediction"] == "benign"
    back = spark.read.option("header", "true").csv(str(tmp_path / "out"))
    assert back.count() == 3 and back.columns[-2:] == ["attack_probability", "prediction"]
    for text in ("Flow Duration,Destination Port\n1,2\n", "Flow Duration, Flow Duration,Flow Bytes/s,Destination Port\n1,1,2,3\n"):
        (tmp_path / "bad.csv").write_text(text)
        with pytest.raises(SchemaError):
            detector.read_flows_csv(spark, str(tmp_path / "bad.csv"), COLUMNS)


def test_comparison(flows):
    table, by_label, best, scorer = detector.compare(flows.where("id < 400"), flows.where("id between 400 and 549"), flows.where("id >= 550"), COLUMNS, F.col("y"), "label", specs=("majority_class", "decision_tree", "random_forest"), trees=5, depth=4)
    got = {(r["model"], r["split"]): r for r in table.collect()}
    assert len(got) == 6 and got[("decision_tree", "test")]["f1"] > 0.8 and got[("decision_tree", "val")]["microseconds_per_row"] > 0
    assert got[(best, "val")]["f1"] == max(got[(s, "val")]["f1"] for s in ("decision_tree", "random_forest")) and scorer.score(flows, ["id"]).count() == 700
    labels = {r["label"]: r for r in by_label.collect()}
    assert sum(r["row_count"] for r in labels.values()) == 150 and labels["DDoS"]["decision_tree"] > 0.7 > labels["BENIGN"]["decision_tree"]


def batch(spark, maps):
    return spark.createDataFrame([(n, m, s) for n, (m, s) in enumerate(maps)], "request int, features map<string,double>, source string")


FINE = {"Flow Duration": 2.0, " Flow Bytes/s ": 1.0, "Destination Port": 80.0, "Label": 0.0}


def test_requests(spark, fitted):
    good = [({**FINE}, None), ({**FINE, "Flow Duration": None, "Destination Port": -INF, " Flow Bytes/s ": NAN}, "x" * 64), ({**FINE, "Flow Duration": -3.0}, "replay:1")]
    bad = [({}, "api"), (None, "api"), ({**FINE, "What": 1.0}, "api"), ({"Flow Duration": 1.0}, "y" * 65)]
    got, refused = requests.score_batch(batch(spark, good + bad), fitted)
    rows = {r["request"]: r for r in got.collect()}
    assert sorted(rows) == [0, 1, 2] and len({r["prediction_id"] for r in rows.values()}) == 3
    assert rows[0]["source"] == "api" and rows[0]["missing"] == [] and rows[1]["missing"] == ["Flow Duration", "Destination Port"]
    assert rows[0]["decision"] == "known_attack" and rows[2]["p"] < 0.5
    assert {r["request"]: r["problems"] for r in refused.collect()} == {3: ["no features", "missing: Destination Port, Flow Bytes/s, Flow Duration"], 4: ["no features"], 5: ["unknown: What"], 6: ["source is longer than 64", "missing: Destination Port, Flow Bytes/s"]}
    extra = batch(spark, good[:1]).select(requests.problems(F.col("features"), F.col("source"), fitted.scorer.prep.expected, F.array(F.lit("z"), F.lit("a"))).alias("p")).first()["p"]
    assert extra == ["more fields: a, z"]
    for n in (0, 3):
        with pytest.raises(ValueError):
            requests.score_batch(batch(spark, good[:n] or good).limit(n), fitted, most=2)
    one = rows[0]
    assert requests.prediction(got, one["prediction_id"])["request"] == 0
    with pytest.raises(KeyError):
        requests.prediction(got, "none")
    cache = {}
    e = requests.explain(got, one["prediction_id"], fitted, 1, cache)
    assert len(e["contributions"]) == 1 and e["contributions"][0]["feature"] == "Flow Duration" and "Flow Duration = 2" in e["sentence"] and e["sentence"].startswith("Attack")
    both = requests.explain(None, one["prediction_id"], fitted, 60, cache)["contributions"]  # from the cache
    assert math.isclose(e["base"] + sum(c["shap"] for c in both), one["p"], abs_tol=1e-6)
    for k in (0, 61):
        with pytest.raises(ValueError):
            requests.explain(got, one["prediction_id"], fitted, k)
    with pytest.raises(KeyError):
        requests.explain(got, "none", fitted)
    m = requests.runtime_metrics(got, F.lit(4.0), started=100.0, now=160.0)
    assert m["uptime_seconds"] == 60 and m["rows"] == 3 and m["mean_milliseconds"] == 4 and set(m["sources"]) == {"api", "x" * 64, "replay:1"}
    assert requests.runtime_metrics(got.limit(0), F.lit(4.0), 0.0)["mean_milliseconds"] is None
