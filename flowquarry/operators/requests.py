"""What a scoring service does with requests, as functions on tables: checks, scoring, look-ups, explanations, counters."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.operators.detector import Detector
from flowquarry.operators.explain import explained, trees_of
from flowquarry.operators.serving import source_counters, top_contributions
from flowquarry.session import stored

MOST_ROWS, LONGEST_SOURCE, MOST_CONTRIBUTIONS = 1000, 64, 60
# Fixed value: a key of features that is no feature and is ignored.
IGNORED = "Label"


def own_features(features: Column) -> Column:
    """The features with trimmed names, without the ignored key."""
    kept = F.map_filter(features, lambda k, _: F.trim(k) != IGNORED)
    return F.transform_keys(kept, lambda k, _: F.trim(k))


def problems(features: Column, source: Column, known: Sequence[str], others: Column | None = None) -> Column:
    """Why a request is turned down, as an array of texts; empty if it is fine.

    features: map of names to numbers; others: further fields of the request, of which there may be none.
    """
    names = F.map_keys(own_features(features))
    want = F.array(*[F.lit(k) for k in known])
    unknown, absent = F.array_sort(F.array_except(names, want)), F.array_sort(F.array_except(want, names))
    tests = [
        F.when(features.isNull() | (F.size(F.coalesce(features, F.create_map().cast("map<string,double>"))) == 0), "no features"),
        F.when(F.length(source) > LONGEST_SOURCE, f"source is longer than {LONGEST_SOURCE}"),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(unknown, ", "))),
        F.when(F.size(absent) > 0, F.concat(F.lit("missing: "), F.array_join(absent, ", "))),
    ]
    if others is not None:
        tests.append(F.when(F.size(others) > 0, F.concat(F.lit("more fields: "), F.array_join(F.array_sort(others), ", "))))
    return F.array_compact(F.array(*tests))


def missing_values(features: Column, known: Sequence[str]) -> Column:
    """Known features whose value is null or infinite (NaN counts as a number that is given), in the order of known."""
    m = own_features(features)
    return F.array_compact(F.array(*[F.when(F.map_contains_key(m, F.lit(k)) & (m[k].isNull() | (F.abs(m[k]) == float("inf"))), F.lit(k)) for k in known]))


def score_batch(requests: DataFrame, detector: Detector, *, most: int = MOST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(predictions, refused) of requests (features map<string,double>, source, ...).

    Predictions get prediction_id, scored_at, p, anomaly_score, decision and missing beside the requests' columns;
    refused requests get their problems. A batch that holds no or more than ``most`` requests is an error.
    """
    n = requests.limit(most + 1).count()
    if not 1 <= n <= most:
        raise ValueError(f"a batch holds 1 to {most} requests")
    known = detector.scorer.prep.expected
    judged = requests.withColumn("source", F.coalesce("source", F.lit("api"))).withColumn("problems", problems(F.col("features"), F.col("source"), known))
    good = judged.where("size(problems) = 0").drop("problems").withColumn("prediction_id", F.expr("uuid()")).withColumn("scored_at", F.current_timestamp())
    good = stored(good.withColumn("missing", missing_values(F.col("features"), known)))  # ids stay as they are from here on
    m = own_features(F.col("features"))
    flat = good.select(*good.columns, *[m[k].alias(k) for k in known])
    scores = detector.score(flat, good.columns, "prediction_id")
    return scores, judged.where("size(problems) > 0")


def prediction(predictions: DataFrame, prediction_id: str):
    """The record of an id; KeyError if there is none (any more)."""
    row = predictions.where(F.col("prediction_id") == prediction_id).first()
    if row is None:
        raise KeyError(prediction_id)
    return row


def sentence(p: float, base: float, raising: Sequence, lowering: Sequence, cut: float = 0.5) -> str:
    """What speaks for and against an attack, in words."""
    said = lambda xs: ", ".join(f"{x['feature']} = {x['value']:,.4g} ({x['shap']:+.3f})" for x in xs) or "nothing"
    return f"{'Attack' if p >= cut else 'Benign'}: probability {p:.3f} against {base:.3f} on average and {cut:g} as the limit. For an attack speak {said(raising)}; against it {said(lowering)}."


def explain(predictions: DataFrame, prediction_id: str, detector: Detector, k: int = 10, cache: dict | None = None) -> dict:
    """The k greatest contributions (1 to 60) to a prediction's probability, with a sentence; KeyError for an unknown id.

    cache keeps the contributions of explained ids, so that each is computed once, whatever k.
    """
    if not 1 <= k <= MOST_CONTRIBUTIONS:
        raise ValueError(f"k must lie between 1 and {MOST_CONTRIBUTIONS}")
    cache = {} if cache is None else cache
    if prediction_id not in cache:
        row = predictions.where(F.col("prediction_id") == prediction_id).limit(1)
        m = own_features(F.col("features"))
        flat = row.select("prediction_id", *[m[c].alias(c) for c in detector.scorer.prep.expected])
        vec = detector.scorer.vectors(flat, ["prediction_id"]).withColumn("v", vector_to_array("__x"))
        items = F.col("contributions")
        got = explained(vec, "v", ["prediction_id"], detector.scorer.prep.kept, trees_of(detector.scorer.model)).select("p", "base", *[c.alias(n) for n, c in top_contributions(items, MOST_CONTRIBUTIONS).items()]).first()
        if got is None:
            raise KeyError(prediction_id)
        cache[prediction_id] = got.asDict(recursive=True)
    x = cache[prediction_id]
    return {"prediction_id": prediction_id, "p": x["p"], "base": x["base"], "contributions": x["top"][:k], "sentence": sentence(x["p"], x["base"], x["raising"], x["lowering"])}


def runtime_metrics(predictions: DataFrame, milliseconds: Column, started: float, now: float | None = None, most: int = 50) -> dict:
    """Uptime, rows, mean milliseconds per row (null without rows), decisions, and the same counters per source."""
    per = source_counters(predictions, F.col("source"), F.col("scored_at"), {"ms": milliseconds.cast("double"), **{d: (F.col("decision") == d).cast("long") for d in ("benign", "anomaly", "known_attack")}}, most).collect()  # most + 1 rows
    n, ms = sum(r["n"] for r in per), sum(r["ms"] or 0.0 for r in per)
    return {
        "uptime_seconds": (time.time() if now is None else now) - started, "rows": n, "mean_milliseconds": ms / n if n else None,
        "decisions": {d: sum(r[d] or 0 for r in per) for d in ("benign", "anomaly", "known_attack")},
        "sources": {r["source"]: {"rows": r["n"], "last_seen": r["last_seen"], "mean_milliseconds": (r["ms"] or 0.0) / r["n"]} for r in per},
    }
