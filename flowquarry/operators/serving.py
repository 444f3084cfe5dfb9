"""Checks of scoring requests, and the tables behind a scoring service: alerts, bounded stores, counters per source."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHER = "(other sources)"


def checked_features(body: Column, known: Sequence[str]) -> dict[str, Column]:
    """Of a JSON object of features: unknown and absent names, names whose value is no number or null, and missing ones.

    Names are trimmed, Label is ignored. Everything is null for text that is no JSON object. missing lists known names
    with null (or infinite) values.
    """
    v = F.try_parse_json(body)
    raw = F.try_variant_get(v, "$", "map<string,variant>")
    m = F.map_filter(raw, lambda k, _: F.trim(k) != "Label")
    names = F.transform(F.map_keys(m), lambda k: F.trim(k))
    kind = lambda x: F.schema_of_variant(x)
    wrong = F.map_filter(m, lambda k, x: ~(kind(x).isin("BIGINT", "DOUBLE", "FLOAT", "VOID") | kind(x).startswith("DECIMAL")))
    none = F.map_filter(m, lambda k, x: kind(x) == "VOID")
    want = F.array(*[F.lit(k) for k in known])
    return {
        "unknown": F.array_sort(F.array_except(names, want)),
        "absent": F.array_sort(F.array_except(want, names)),
        "not_numeric": F.array_sort(F.transform(F.map_keys(wrong), lambda k: F.trim(k))),
        "missing": F.array_sort(F.transform(F.map_keys(none), lambda k: F.trim(k))),
    }


def newest_alerts(records: DataFrame, decision: Column, order: Sequence[Column], limit: int = 100, wanted: Sequence[str] = ("anomaly", "known_attack")) -> DataFrame:
    """The newest records whose decision is wanted (benign may not be), at most limit (1 to 1000)."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must lie between 1 and 1000")
    if "benign" in wanted:
        raise ValueError("benign records are no alerts")
    return records.where(decision.isin(*wanted)).orderBy(*[o.desc() for o in order]).limit(limit)


def bounded_store(records: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """The last ``size`` records by order: what a store of that size still holds."""
    return records.orderBy(*[o.desc() for o in order]).limit(size)


def store_state(records: DataFrame, decision: Column, size: int) -> DataFrame:
    """One row: records held and evicted, and the counts of decisions over all time."""
    n = F.count("*")
    return records.agg(F.least(n, F.lit(size)).alias("held"), F.greatest(n - size, F.lit(0)).alias("evicted"), *[F.count_if(decision == d).alias(d) for d in ("benign", "anomaly", "known_attack")])


def source_counters(records: DataFrame, source: Column, at: Column, sums: dict[str, Column], most: int = 50) -> DataFrame:
    """(source, n, last_seen, sums...): counters of the ``most`` sources seen first, the others together.

    Counts come first, one row per source; their order of appearance is then ranked on these rows.
    """
    per = records.groupBy(F.coalesce(source, F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), *[F.sum(c).alias(k) for k, c in sums.items()])
    first = per.orderBy("first_seen", "source").limit(most).select(F.col("source").alias("known"))
    named = per.join(F.broadcast(first), F.col("source") == F.col("known"), "left")  # at most ``most`` rows
    return named.groupBy(F.when(F.col("known").isNotNull(), F.col("source")).otherwise(OTHER).alias("source")).agg(F.sum("n").alias("n"), F.max("last_seen").alias("last_seen"), *[F.sum(k).alias(k) for k in sums])


def recent_sources(counters: DataFrame, now: Column, prefix: str = "replay:", seconds: int = 15) -> DataFrame:
    """Sources of the prefix last seen less than the given seconds before now, the newest first."""
    return counters.where(F.col("source").startswith(prefix) & (F.col("last_seen") > now - F.expr(f"interval {seconds} seconds"))).orderBy(F.desc("last_seen"), "source")


def batches(df: DataFrame, by: Sequence[str], order: str, size: int, *, block: int = 1 << 16) -> DataFrame:
    """df with batch_no and row_no within each group: slices of ``size`` rows in the order of a whole-number column.

    Rows are ranked within blocks of the order column and offset by the rows of the blocks before, so that a group
    with very many rows is sorted by many tasks. Equal order values are told apart by nothing: they should be unique.
    """
    names = [f"__b{i}" for i in range(len(by))]
    d = df.withColumn("__o", F.floor(F.col(order) / block))
    per = d.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("__o").alias("__p")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*names).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    start = per.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names)] + [F.col("__o").eqNullSafe(F.col("__p"))]
    rank = F.row_number().over(Window.partitionBy(*by, "__o").orderBy(order)) - 1
    at = F.col("__r") + F.col("__start")
    ranked = d.withColumn("__r", rank).join(start, reduce(lambda a, b: a & b, on))
    return ranked.withColumn("batch_no", F.floor(at / size).cast("long")).withColumn("row_no", (at % size).cast("long")).drop("__r", "__o", "__p", "__start", *names)


def schedule(sizes: DataFrame, batch: str, n: str, rate: float, *, block: int = 1 << 14) -> DataFrame:
    """Due second of each batch: rows sent before it divided by the rate; sums within blocks of batches, then of the blocks before."""
    d = sizes.withColumn("__o", F.floor(F.col(batch) / block))
    per = d.groupBy("__o").agg(F.sum(n).alias("__n"))
    blocks = per.select(F.col("__o").alias("__p"), F.coalesce(F.sum("__n").over(Window.orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))  # one row per block
    within = Window.partitionBy("__o").orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    j = d.withColumn("__w", F.coalesce(F.sum(n).over(within), F.lit(0))).join(blocks, F.col("__o") == F.col("__p"))
    return j.withColumn("due", (F.col("__w") + F.col("__start")) / F.lit(rate)).drop("__o", "__p", "__w", "__start")


def top_contributions(items: Column, k: int) -> dict[str, Column]:
    """Of an array of (feature, value, shap): the k with the greatest |shap|, and the three greatest of each sign."""
    by = lambda f: F.array_sort(items, lambda a, b: F.when(f(a) > f(b), -1).when(f(a) < f(b), 1).when(a["feature"] < b["feature"], -1).otherwise(1))
    return {
        "top": F.slice(by(lambda x: F.abs(x["shap"])), 1, k),
        "raising": F.slice(F.filter(by(lambda x: x["shap"]), lambda x: x["shap"] > 0), 1, 3),
        "lowering": F.slice(F.filter(by(lambda x: -x["shap"]), lambda x: x["shap"] < 0), 1, 3),
    }


def sniffed(cell: Column) -> Column:
    """A cell of a report: whole number, decimal number (with point or exponent) or text, as (kind, number, text)."""
    number = cell.try_cast("double")
    decimal = F.lower(cell).rlike(r"[.e]")
    kind = F.when(number.isNull(), "text").when(decimal, "float").otherwise("int")
    return F.struct(kind.alias("kind"), number.alias("number"), F.when(number.isNull(), cell).alias("text"))
