"""Queries that learn: classifiers, isolation forest, explanations, and scans of files. SQL cannot express them."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.scalars import is_finite, q
from flowquarry.operators import detector, explain, iforest, metrics, models
from flowquarry.operators.features import fit_preprocessor, fit_preprocessors_without
from flowquarry.operators.sampling import order_key, stratified_sample
from flowquarry.plans.flowqueries import FEATURES
from flowquarry.plans.registry import Query, collector, table
from flowquarry.session import shared_dir, stored
from flowquarry.sources import files

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
query = collector(QUERIES, SQL)

KEEP = ["flow_id", "label", "family", "is_attack", "split"]


def _flows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "flows").where("is_attack is not null")


def _forest(spark: SparkSession, sf: str) -> tuple[DataFrame, models.Scorer]:
    f = _flows(spark, sf)
    return f, models.fit(f.where("split = 'train'"), FEATURES, F.col("is_attack"), "random_forest")


@query()
def random_forest_scores(spark: SparkSession, sf: str) -> DataFrame:
    f, s = _forest(spark, sf)
    return s.score(f.where("split = 'test'"), KEEP)


@query()
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of each classifier on val and test, with the time of scoring and the choice by F1 on val."""
    f = _flows(spark, sf)
    part = lambda s: f.where(F.col("split") == s)
    table_, _, best, _ = detector.compare(part("train"), part("val"), part("test"), FEATURES, F.col("is_attack"), "label")
    return table_.withColumn("best", F.col("model") == best)


@query()
def model_label_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Per label of the test flows the share that each classifier flags, side by side."""
    f = _flows(spark, sf)
    return detector.label_rates(f.where("split = 'train'"), f.where("split = 'test'"), FEATURES, F.col("is_attack"), "label")


@query()
def leave_one_family_out(spark: SparkSession, sf: str) -> DataFrame:
    f = _flows(spark, sf).where("family is not null")
    s = models.leave_one_out(f.where("split = 'train'"), f.where("split = 'test'"), "family", FEATURES, F.col("is_attack"), "BENIGN", KEEP)
    return metrics.held_out_rates(s, "held", F.col("family"), F.col("is_attack"), {"forest": F.col("p") >= 0.5})


@query()
def leave_one_family_out_with_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    """The same beside the three-way decision: what the classifier misses of the family that it hasn't seen may be an anomaly."""
    f = _flows(spark, sf).where("family is not null")
    train = f.where("split = 'train'")
    families = [r[0] for r in train.select("family").distinct().collect()]  # one name per family
    none = "".join(families) + "-"  # no family's name
    preps = fit_preprocessors_without(train, FEATURES, "family", [*families, none])
    prep = preps[none]
    forest = iforest.fit_isolation_forest(prep.transform(f.where("split = 'train' and is_attack = 0"), ["flow_id"]), prep.kept, "flow_id")
    scored = stored(forest.transform(prep.transform(f.where("split <> 'train'"), ["flow_id", "split", "is_attack"])).select("flow_id", "split", "is_attack", "anomaly_score"))
    limit = metrics.threshold_for_fpr(scored.where("split = 'val' and is_attack = 0"), "anomaly_score", [0.01]).first()["threshold"]  # one number
    s = models.leave_one_out(train, f.where("split = 'test'"), "family", FEATURES, F.col("is_attack"), "BENIGN", KEEP, preps=preps)
    both = s.join(scored.where("split = 'test'").select("flow_id", "anomaly_score"), "flow_id")
    decision = metrics.hybrid_decision(F.col("p"), F.col("anomaly_score"), limit)
    return metrics.held_out_rates(both, "held", F.col("family"), F.col("is_attack"), {"forest": F.col("p") >= 0.5, "anomaly": F.col("anomaly_score") >= limit, "hybrid": decision != "benign"})


@query()
def held_out_friday(spark: SparkSession, sf: str) -> DataFrame:
    s = models.held_out_prefix(_flows(spark, sf), "source_file", "Friday", FEATURES, F.col("is_attack"), KEEP)
    return metrics.rates(metrics.confusion(s, F.col("is_attack"), F.col("p") >= 0.5))


@query()
def isolation_forest_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Trained on benign rows of train; test rows with their anomaly score."""
    f = _flows(spark, sf)
    prep = fit_preprocessor(f.where("split = 'train'"), FEATURES)
    benign = prep.transform(f.where("split = 'train' and is_attack = 0"), ["flow_id"])
    forest = iforest.fit_isolation_forest(benign, prep.kept, "flow_id")
    return forest.transform(prep.transform(f.where("split = 'test'"), ["flow_id", "is_attack"])).select("flow_id", "is_attack", "anomaly_score")


@query()
def shap_contributions(spark: SparkSession, sf: str) -> DataFrame:
    """Contributions for 20 test flows of each label, with the error of their sum."""
    f, s = _forest(spark, sf)
    some = stratified_sample(f.where("split = 'test'"), F.col("label"), 20, order_key("42", F.col("flow_id")))
    vec = s.vectors(some, ["flow_id", "label"]).withColumn("v", vector_to_array("__x"))
    got = explain.explained(vec, "v", ["flow_id", "label"], s.prep.kept, explain.trees_of(s.model))
    total = F.aggregate("contributions", F.col("base"), lambda a, c: a + c["shap"])
    return got.withColumn("additivity_error", F.abs(total - F.col("p")))


@query()
def shap_importance(spark: SparkSession, sf: str) -> DataFrame:
    return explain.importance(shap_contributions(spark, sf), ["label"])


def _csv_folder(spark: SparkSession, sf: str) -> str:
    """The flows as one CSV per source_file, in three encodings and containers, where all executors can read them."""
    folder = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    named = table(spark, sf, "flows")
    files.write_csv_files(named, folder, "source_file", [*FEATURES, "label", "flow_id"], variant=F.pmod(F.xxhash64("source_file"), F.lit(3))).count()
    return folder


@query("""select source_file, count(*) as row_count, count(*) filter (isfinite("Flow Bytes/s")) as finite, count(*) filter (isinf("Flow Packets/s")) as infinite,
  sum(flow_id)::bigint as ids, count(label) as labelled, 0::bigint as unparseable from flows where source_file is not null group by 1""")
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All flows written as files and read back into one table: rows, cells and ids per file."""
    rows, _ = files.read_rows(spark, files.discover(_csv_folder(spark, sf)))
    typed = files.to_numbers(rows, [*FEATURES, "flow_id"], ["source_file", "label"])
    b, p = q("Flow Bytes/s"), q("Flow Packets/s")
    return typed.groupBy("source_file").agg(
        F.count("*").alias("row_count"), F.count_if(is_finite(b)).alias("finite"), F.count_if(F.abs(p) == float("inf")).alias("infinite"), F.sum(F.col("flow_id").cast("long")).alias("ids"), F.count("label").alias("labelled"), F.sum("__unparseable").alias("unparseable")
    )


@query("select source_file as name, count(*) + 1 as line_count, 24 as columns from flows where source_file is not null group by 1")
def file_scan(spark: SparkSession, sf: str) -> DataFrame:
    return files.scan_files(spark, files.discover(_csv_folder(spark, sf))).select("name", "line_count", F.size("header").alias("columns"))


@query()
def port_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """The forest with and without the excluded column."""
    f = _flows(spark, sf)
    out = None
    for name, exclude in (("without port", ("Destination Port",)), ("with port", ())):
        s = models.fit(f.where("split = 'train'"), FEATURES, F.col("is_attack"), exclude=exclude).score(f.where("split = 'test'"), KEEP)
        row = metrics.rates(metrics.confusion(s, F.col("is_attack"), F.col("p") >= 0.5)).withColumn("features", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query()
def detector_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Classifier, isolation forest and the three-way decision for the test flows."""
    f = _flows(spark, sf)
    fitted = detector.fit_detector(f.where("split = 'train'"), f.where("split = 'val'"), FEATURES, F.col("is_attack"), "flow_id", target_fpr=0.05)
    return fitted.score(f.where("split = 'test'"), ["flow_id"], "flow_id")
