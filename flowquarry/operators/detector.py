"""Scorers and detectors that can be saved and loaded, and predictions for files of flows."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import classification
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.scalars import q
from flowquarry.operators import iforest, models
from flowquarry.operators.features import Preprocessor, SchemaError, scaled
from flowquarry.operators.forest import ForestModel
from flowquarry.operators.iforest import IsolationForest
from flowquarry.operators.metrics import hybrid_decision, threshold_for_fpr
from flowquarry.session import stored
from flowquarry.sources.sinks import read_text, write_text


def save_scorer(spark: SparkSession, scorer: models.Scorer, folder: str) -> None:
    """The preprocessor as JSON and the classifier as an MLlib model (a forest as JSON), in folder; what was there is replaced."""
    constant, forest = isinstance(scorer.model, float), isinstance(scorer.model, ForestModel)
    if forest:
        write_text(spark, f"{folder}/forest.json", json.dumps(scorer.model.describe()))
    elif not constant:
        scorer.model.write().overwrite().save(f"{folder}/model")
    write_text(spark, f"{folder}/scorer.json", json.dumps({"preprocessor": scorer.prep.describe(), "constant": scorer.model if constant else None, "kind": None if constant else type(scorer.model).__name__}))


def load_scorer(spark: SparkSession, folder: str) -> models.Scorer:
    about = json.loads(read_text(spark, f"{folder}/scorer.json"))
    if about["kind"] == ForestModel.__name__:
        model = ForestModel(**json.loads(read_text(spark, f"{folder}/forest.json")))
    else:
        model = about["constant"] if about["kind"] is None else getattr(classification, about["kind"]).load(f"{folder}/model")
    return models.Scorer(Preprocessor(**about["preprocessor"]), model)


@dataclass
class Detector:
    """A classifier, an isolation forest on the same features, and the anomaly score from which benign flows become anomalies."""

    scorer: models.Scorer
    forest: IsolationForest
    threshold: float
    target_fpr: float

    def score(self, df: DataFrame, keep: Sequence[str], key: str) -> DataFrame:
        """keep with p, anomaly_score and decision; key is unique and among keep."""
        names = [q(c) for c in keep]
        flat = self.scorer.prep.transform(df, [key])
        scores = self.forest.transform(flat).select(q(key), "anomaly_score")
        both = self.scorer.score(df, keep).join(scores, key)
        return both.select(*names, "p", "anomaly_score", hybrid_decision(F.col("p"), F.col("anomaly_score"), self.threshold).alias("decision"))

    def info(self) -> dict:
        """What a client has to know: names expected and used, what was dropped, sizes and thresholds."""
        p = self.scorer.prep
        kind = "constant" if isinstance(self.scorer.model, float) else type(self.scorer.model).__name__
        return {
            "features": list(p.expected), "features_used": list(p.kept), "features_used_count": len(p.kept), "excluded": list(p.excluded), "constant": list(p.constant), "repeated": dict(p.duplicate_of),
            "classifier": kind, "classifier_threshold": 0.5, "anomaly_trees": len(self.forest.trees), "anomaly_sample": self.forest.sample, "anomaly_threshold": self.threshold, "target_fpr": self.target_fpr,
        }

    def save(self, spark: SparkSession, folder: str) -> None:
        save_scorer(spark, self.scorer, f"{folder}/scorer")
        trees = [t.tolist() for t in self.forest.trees]
        write_text(spark, f"{folder}/detector.json", json.dumps({"features": list(self.forest.features), "trees": trees, "sample": self.forest.sample, "threshold": self.threshold, "target_fpr": self.target_fpr}))

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Detector:
        about = json.loads(read_text(spark, f"{folder}/detector.json"))
        forest = IsolationForest(about["features"], [np.array(t) for t in about["trees"]], about["sample"])
        return Detector(load_scorer(spark, f"{folder}/scorer"), forest, about["threshold"], about["target_fpr"])


def fit_detector(train: DataFrame, val: DataFrame, columns: Sequence[str], y: Column, key: str, *, target_fpr: float = 0.01, spec: str = "random_forest", anomaly_trees: int = 200, **how: object) -> Detector:
    """Classifier from train, isolation forest from its benign rows, threshold from the benign rows of val."""
    scorer = models.fit(train, columns, y, spec, **how)
    prep = scorer.prep
    forest = iforest.fit_isolation_forest(prep.transform(train.where(y == 0), [key]), prep.kept, key, trees=anomaly_trees)
    benign = forest.transform(prep.transform(val.where(y == 0), [key])).select("anomaly_score")
    return Detector(scorer, forest, float(threshold_for_fpr(benign, "anomaly_score", [target_fpr]).first()["threshold"]), target_fpr)


def read_flows_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV of flows with space around names taken away; the given columns as doubles (text that is no number is missing).

    A name that comes twice after that, or a column that is missing, is an error.
    """
    raw = spark.read.options(header="true", enforceSchema="false").csv(path)
    names = [c.strip() for c in raw.columns]
    if len(set(names)) < len(names):
        raise SchemaError(f"repeated columns: {sorted({n for n in names if names.count(n) > 1})}")
    df = raw.toDF(*names)
    if missing := [c for c in columns if c not in names]:
        raise SchemaError(f"missing columns: {missing}")
    return df.select(*[q(c).try_cast("double").alias(c) if c in columns else q(c) for c in names])


def predict_csv(spark: SparkSession, path: str, scorer: models.Scorer, out: str | None = None, name: str = "attack_probability", cut: float = 0.5) -> DataFrame:
    """The rows of a CSV with the probability and the verdict; written as CSV with a header to out, if given."""
    flows = read_flows_csv(spark, path, scorer.prep.expected)
    got = scorer.score(flows, flows.columns, name).withColumn("prediction", F.when(F.col(name) >= cut, "attack").otherwise("benign"))
    if out is not None:
        got.write.mode("overwrite").option("header", "true").csv(out)
    return got


def _fitted(train: DataFrame, columns: Sequence[str], y: Column, specs: Sequence[str], **how: object) -> Iterator[tuple[str, models.Scorer]]:
    """Each classifier by name; the preprocessing is learned once."""
    plain = models.fit_preprocessor(train, columns, **{k: v for k, v in how.items() if k == "exclude"})
    for spec in specs:
        yield spec, models.fit(train, columns, y, spec, **how, prep=scaled(train, plain) if spec == "logistic_regression" else plain)


def label_rates(train: DataFrame, test: DataFrame, columns: Sequence[str], y: Column, label: str, specs: Sequence[str] = models.SPECS, **how: object) -> DataFrame:
    """The rates by label that compare gives, the most frequent label first: all classifiers score test in one pass, val isn't needed."""
    names = dict.fromkeys(columns)
    rows = test.select(q(label).alias("__label"), *[q(c) for c in names])
    marks = []
    for i, (_, s) in enumerate(_fitted(train, columns, y, specs, **how)):
        rows = s.score(rows, ["__label", *names, *marks], f"__p{i}")
        marks.append(f"__p{i}")
    rates = [(F.count_if(F.coalesce(F.col(p) >= 0.5, F.lit(False))) / F.count("*")).alias(spec) for p, spec in zip(marks, specs)]
    return rows.groupBy(F.col("__label").alias("label")).agg(F.count("*").alias("row_count"), *rates).orderBy(F.desc("row_count"), "label")


def compare(train: DataFrame, val: DataFrame, test: DataFrame, columns: Sequence[str], y: Column, label: str, specs: Sequence[str] = models.SPECS, **how: object) -> tuple[DataFrame, DataFrame, str, models.Scorer]:
    """(metrics, rates by label, name of the best, its scorer) of several classifiers.

    metrics: one row per model and split, with microseconds per row of scoring; rates by label: per label of test its rows
    and a column per model with the share flagged. The best has the highest F1 on val, the majority class left out; the
    first of equals.
    """
    import time

    from flowquarry.operators import metrics as M

    table, counts, scorers, f1 = None, None, {}, {}
    truth = "__truth"
    for spec, s in _fitted(train, columns, y, specs, **how):
        scorers[spec] = s
        for split, part in (("val", val), ("test", test)):
            rows = part.select(q(label).alias("label"), y.cast("int").alias(truth), *[q(c) for c in dict.fromkeys(columns)])
            began = time.monotonic()
            p = stored(s.score(rows, ["label", truth]))  # each row is scored once
            took = time.monotonic() - began
            n = p.count()
            rated = M.rates(M.confusion(p, F.col(truth), F.col("p") >= 0.5))
            if split == "val":
                f1[spec] = rated.first()["f1"]
            row = rated.crossJoin(M.ranking_metrics(p, F.col(truth), F.col("p")))  # two single rows
            row = row.select(F.lit(spec).alias("model"), F.lit(split).alias("split"), "*", F.lit(1e6 * took / n if n else None).cast("double").alias("microseconds_per_row"))
            table = row if table is None else table.unionByName(row)
        per = M.per_label_rates(p, F.col("label"), F.col("p") >= 0.5).select(F.col("label").alias("l"), "row_count", F.col("rate").alias(spec))
        counts = per.select("l", "row_count", spec) if counts is None else counts.join(per.drop("row_count").withColumnRenamed("l", "k"), F.col("l").eqNullSafe(F.col("k"))).drop("k")
    best = max((s for s in specs if s != "majority_class"), key=lambda s: f1[s] or 0.0, default=specs[0])
    return table, counts.withColumnRenamed("l", "label"), best, scorers[best]
