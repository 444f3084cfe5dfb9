"""Repeated rows, rows with the same features under different labels, and keeping the first of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.scalars import canonical, q, row_key


def keyed(df: DataFrame, features: Sequence[str], label: Column, file: Column, *extra: Column) -> DataFrame:
    """(k1, k2, label, file, extra...): the features as a 128-bit key; missing cells are equal to each other."""
    k1, k2 = row_key(*[canonical(q(c).cast("double")) for c in features])
    return df.select(k1.alias("k1"), k2.alias("k2"), label.alias("label"), file.alias("file"), *extra)


def duplicate_summary(keys: DataFrame) -> DataFrame:
    """One row: exact duplicates (features and label), within and across files, unique rows and unique vectors.

    One aggregation by (features, label, file) carries all counts; what follows works on groups, not rows.
    """
    g = keys.groupBy("k1", "k2", "label", "file").agg(F.count("*").alias("n"))
    per = g.groupBy("k1", "k2", "label").agg(F.sum("n").alias("n"), F.count("*").alias("files"))
    vec = per.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.sum("files").alias("files"), F.count("*").alias("labels"))
    s = vec.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum("labels"), F.lit(0)).alias("unique_rows"), F.coalesce(F.sum("files"), F.lit(0)).alias("per_file"), F.count("*").alias("unique_vectors"))
    exact = F.col("row_count") - F.col("unique_rows")
    within = F.col("row_count") - F.col("per_file")
    return s.select("row_count", exact.alias("exact_duplicates"), within.alias("within_files"), (exact - within).alias("across_files"), "unique_rows", "unique_vectors")


def redundant_by(keys: DataFrame, by: str) -> DataFrame:
    """Per label or file: rows, rows that repeat an earlier one of that label or file, and their percentage."""
    cols = ["k1", "k2", "label"] if by == "label" else ["k1", "k2", "label", "file"]
    g = keys.groupBy(*cols).agg(F.count("*").alias("n"))
    out = g.groupBy(by).agg(F.sum("n").alias("row_count"), (F.sum("n") - F.count("*")).alias("redundant"))
    return out.withColumn("pct", F.round(F.lit(100.0) * F.col("redundant") / F.col("row_count"), 2))


def conflicting_label_sets(keys: DataFrame) -> DataFrame:
    """(labels, vectors, row_count): sets of labels that the same features go by, with how many vectors and rows they cover."""
    per = keys.groupBy("k1", "k2", "label").agg(F.count("*").alias("n"))
    vec = per.groupBy("k1", "k2").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("label", F.lit("<missing>")))), " | ").alias("labels"), F.count("*").alias("k"), F.sum("n").alias("n"))  # at most one entry per label
    return vec.where("k > 1").groupBy("labels").agg(F.count("*").alias("vectors"), F.sum("n").alias("row_count"))


def conflicting_rows(keys: DataFrame) -> DataFrame:
    """Rows whose features also go by another label."""
    bad = keys.groupBy("k1", "k2").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count_if(F.col("label").isNull()).alias("n")).where("a <> b or (n > 0 and a is not null)").select("k1", "k2")
    return keys.join(bad, ["k1", "k2"], "left_semi")


def keep_first(df: DataFrame, features: Sequence[str], label: Column, order: Sequence[Column]) -> DataFrame:
    """df without the rows whose features and label an earlier row has, by the given total order.

    Ranks within copies: the rank's group limit drops later copies before the shuffle, so that a row with very many
    copies is no heavy group.
    """
    k1, k2 = row_key(*[canonical(q(c).cast("double")) for c in features], label)
    w = Window.partitionBy("__k1", "__k2").orderBy(*order)
    return df.select("*", k1.alias("__k1"), k2.alias("__k2")).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__k1", "__k2", "__rn")


def removal_report(df: DataFrame, kept: DataFrame, by: Column, name: str) -> DataFrame:
    """(name, rows_in, rows_out, removed) per value of by."""
    a = df.groupBy(by.alias(name)).agg(F.count("*").alias("rows_in"))
    b = kept.groupBy(by.alias(name)).agg(F.count("*").alias("rows_out"))
    j = a.alias("a").join(b.alias("b"), F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}")), "left")
    out = F.coalesce("rows_out", F.lit(0))
    return j.select(F.col(f"a.{name}").alias(name), "rows_in", out.alias("rows_out"), (F.col("rows_in") - out).alias("removed"))
