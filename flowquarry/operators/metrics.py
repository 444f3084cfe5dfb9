"""Detection metrics: confusion counts and rates, ROC-AUC, average precision, thresholds, rates per label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.scalars import at_least, finite_or_null
from flowquarry.operators.orderstats import exact_quantiles

NAN = float("nan")


def confusion(df: DataFrame, y: Column, flag: Column, by: Sequence[str] = ()) -> DataFrame:
    """(by..., tn, fp, fn, tp) of 0/1 truth and a boolean flag (null flags count as false; rows without truth take no part)."""
    yes = F.coalesce(flag, F.lit(False))
    return df.groupBy(*by).agg(F.count_if((y == 0) & ~yes).alias("tn"), F.count_if((y == 0) & yes).alias("fp"), F.count_if((y == 1) & ~yes).alias("fn"), F.count_if((y == 1) & yes).alias("tp"))


def rates(counts: DataFrame, policy: str = "zero") -> DataFrame:
    """counts with accuracy, precision, recall, f1 and fpr.

    What an empty denominator gives: "zero" 0 (fpr NaN), "nan" NaN (f1 0 if tp is 0), "null" null.
    """
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    div = lambda a, b, empty: F.coalesce(F.try_divide(a, b), F.lit(empty)) if policy != "null" else F.try_divide(a, b)
    empty = 0.0 if policy == "zero" else NAN
    f1 = F.when(tp == 0, F.lit(0.0)).otherwise(2 * tp / (2 * tp + fp + fn)) if policy != "null" else F.try_divide(2 * tp, 2 * tp + fp + fn)
    return counts.select("*", div(tp + tn, tn + fp + fn + tp, NAN).alias("accuracy"), div(tp, tp + fp, empty).alias("precision"), div(tp, tp + fn, empty).alias("recall"), f1.alias("f1"), div(fp, fp + tn, NAN).alias("fpr"))


def _by_score(df: DataFrame, y: Column, score: Column) -> DataFrame:
    """Distinct scores with their rows and positives, and what stands at or above each; from counts per range of scores.

    Equal scores are one row, so that the windows run over distinct scores; these are cut into ranges whose totals are
    added up first, so that no task orders all of them.
    """
    d = df.select(finite_or_null(score.cast("double")).alias("s"), y.cast("long").alias("y")).where("s is not null and y is not null")
    per = d.groupBy((F.col("s") + F.lit(0.0)).alias("s")).agg(F.count("*").alias("n"), F.sum("y").alias("tp"))
    cut = F.floor(F.signum("s") * F.log1p(F.abs("s")) * 65536)
    per = per.withColumn("cut", cut)
    totals = per.groupBy("cut").agg(F.sum("n").alias("cn"), F.sum("tp").alias("ct"))
    above = Window.orderBy(F.desc("cut")).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = totals.select("cut", F.coalesce(F.sum("cn").over(above), F.lit(0)).alias("bn"), F.coalesce(F.sum("ct").over(above), F.lit(0)).alias("bt"))
    within = Window.partitionBy("cut").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("wn", F.sum("n").over(within)).withColumn("wt", F.sum("tp").over(within)).join(totals, "cut").select("s", "n", "tp", (F.col("wn") + F.col("bn")).alias("upto_n"), (F.col("wt") + F.col("bt")).alias("upto_tp"))


def ranking_metrics(df: DataFrame, y: Column, score: Column) -> DataFrame:
    """One row (positives, negatives, roc_auc, average_precision).

    ROC-AUC counts ties half; average precision is the step sum over falling scores. Both are null if one class is
    missing. Rows with a null or non-finite score or null truth take no part.
    """
    b = _by_score(df, y, score)
    neg = F.col("n") - F.col("tp")
    neg_upto = F.col("upto_n") - F.col("upto_tp")
    # pairs of a positive and a negative: the positive's score is higher, or equal (half)
    g = b.agg(
        F.coalesce(F.sum("tp"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum(neg), F.lit(0)).alias("negatives"),
        F.sum(F.col("tp").cast("double") * (neg_upto - neg) + F.col("tp").cast("double") * neg / 2).alias("lost"),
        F.sum(F.col("tp") * (F.col("upto_tp").cast("double") / F.col("upto_n"))).alias("steps"),
    )
    pn = F.col("positives").cast("double") * F.col("negatives")
    both = pn > 0
    return g.select("positives", "negatives", F.when(both, 1 - F.col("lost") / pn).alias("roc_auc"), F.when(both, F.col("steps") / F.col("positives")).alias("average_precision"))


def per_label_rates(df: DataFrame, label: Column, flag: Column) -> DataFrame:
    """(label, row_count, flagged, rate) per label, the most frequent first."""
    yes = F.coalesce(flag, F.lit(False))
    got = df.groupBy(label.alias("label")).agg(F.count("*").alias("row_count"), F.count_if(yes).alias("flagged")).withColumn("rate", F.col("flagged") / F.col("row_count"))
    return got.orderBy(F.desc("row_count"), "label")


def threshold_for_fpr(df: DataFrame, score: str, targets: Sequence[float]) -> DataFrame:
    """(target_fpr, threshold): exact quantiles (linear interpolation) of the scores of benign rows."""
    got = exact_quantiles(df.select(F.lit(0).alias("__g"), F.col(f"`{score}`")), ["__g"], score, [1 - t for t in targets])
    back = F.create_map(*[F.lit(x) for t in targets for x in (1 - t, t)])
    return got.select(F.element_at(back, F.col("prob")).alias("target_fpr"), F.col("quantile").alias("threshold"))


def hybrid_decision(p: Column, a: Column, threshold: Column | float, cut: float = 0.5) -> Column:
    """known_attack where p reaches the cut, else anomaly where a reaches the threshold, else benign; NaN and null reach nothing."""
    return F.when(at_least(p, cut), "known_attack").when(at_least(a, threshold), "anomaly").otherwise("benign")


DECISIONS = ("benign", "anomaly", "known_attack")


def decision_counts(df: DataFrame, decision: Column) -> DataFrame:
    """(decision, n) with a row for each decision, whether it occurs or not."""
    counts = df.groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(d,) for d in DECISIONS], "decision string")
    return every.join(counts, "decision", "left").select("decision", F.coalesce("n", F.lit(0)).alias("n"))


def tally(df: DataFrame, label: Column, decision: Column) -> DataFrame:
    """Label by decision, as a contingency table."""
    return df.select(label.alias("label"), decision.alias("decision")).groupBy("label").pivot("decision", list(DECISIONS)).count().na.fill(0, list(DECISIONS))


def tally_summary(df: DataFrame, is_attack: Column, decision: Column) -> DataFrame:
    """recall, fpr and precision if only known attacks count as alerts, and if any alert does; null on empty denominators."""
    parts = [rates(confusion(df, is_attack.cast("int"), flag), "null").select(F.lit(name).alias("alerts"), "tn", "fp", "fn", "tp", "recall", "fpr", "precision") for name, flag in (("known_attack_only", decision == "known_attack"), ("any_alert", decision != "benign"))]
    return parts[0].unionByName(parts[1])


def held_out_rates(df: DataFrame, held: str, family: Column, is_attack: Column, flags: dict[str, Column]) -> DataFrame:
    """Per held-out family: recall on it, on the other attacks, and the rate on benign rows, of each flag; null if empty."""
    fam = df.select(F.col(held).alias("held"), family.alias("f"), is_attack.alias("y"), *[F.coalesce(c, F.lit(False)).cast("double").alias(n) for n, c in flags.items()])
    own, seen, benign = F.col("f") == F.col("held"), (F.col("y") == 1) & ((F.col("f") != F.col("held")) | F.col("f").isNull()), F.col("y") == 0
    return fam.groupBy("held").agg(*[F.avg(F.when(m, F.col(n))).alias(f"{n}_{k}") for n in flags for k, m in (("held_out_recall", own), ("seen_recall", seen), ("fpr", benign))])


def best_model(results: DataFrame, score: str, position: str, exclude: Column) -> DataFrame:
    """The first (by position) of the rows with the highest score, leaving out those of exclude."""
    return results.where(~exclude).orderBy(F.desc(score), F.asc(position)).limit(1)
