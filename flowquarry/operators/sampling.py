"""Samples and splits that depend on keys only, never on partitions or on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(seed: str, *cols: Column) -> Column:
    """A reproducible random order: the MD5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols]))


def stratified_sample(df: DataFrame, stratum: Column, k: int, key: Column) -> DataFrame:
    """The k rows of each stratum with the smallest keys (ties by nothing: keys must be unique); null is a stratum.

    WindowGroupLimit keeps k rows of a stratum per task before the shuffle.
    """
    w = Window.partitionBy("__s").orderBy("__k")
    return df.select("*", stratum.alias("__s"), key.alias("__k")).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__s", "__k", "__rn")


def bottom_k(df: DataFrame, k: int, key: Column) -> DataFrame:
    """The k rows with the smallest keys."""
    return df.orderBy(key).limit(k)


#: Prefixes of the order key that a stratum is cut into when it is ranked.
SLICES = 4096


def ranked(df: DataFrame, stratum: Column, key: Column) -> DataFrame:
    """df with __rn (rank by key within the stratum) and __n (rows of the stratum).

    A stratum is cut by the first three hexadecimal digits of the key, which follow its order: ranks within a cut plus
    the rows of the cuts before it, so that no task sorts a whole stratum.
    """
    d = df.select("*", stratum.alias("__s"), key.alias("__k")).withColumn("__c", F.substring("__k", 1, 3))
    cuts = d.groupBy("__s", "__c").agg(F.count("*").alias("n"))
    run = Window.partitionBy("__s").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    base = cuts.select(F.col("__s").alias("s2"), F.col("__c").alias("c2"), F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("__s")).alias("__n"))  # at most SLICES rows a stratum
    inner = d.withColumn("r", F.row_number().over(Window.partitionBy("__s", "__c").orderBy("__k")))
    return inner.join(base, F.col("__s").eqNullSafe(F.col("s2")) & (F.col("__c") == F.col("c2"))).withColumn("__rn", F.col("r") + F.col("before")).drop("s2", "c2", "r", "before", "__c", "__k")


def stratified_split(df: DataFrame, stratum: Column, key: Column, *, train: float = 0.7, name: str = "split") -> DataFrame:
    """df with a split column: per stratum round(train * n) rows for train, half of the rest (rounded up) val, else test."""
    r = ranked(df, stratum, key)
    quota = F.floor(F.lit(train) * F.col("__n") + 0.5)
    val = F.ceil((F.col("__n") - quota) / 2)
    split = F.when(F.col("__rn") <= quota, "train").when(F.col("__rn") <= quota + val, "val").otherwise("test")
    return r.withColumn(name, split).drop("__s", "__rn", "__n")


def split_table(df: DataFrame, stratum: str, split: str = "split") -> DataFrame:
    """Stratum by split: rows in train, val and test."""
    return df.groupBy(stratum).pivot(split, ["train", "val", "test"]).count().na.fill(0, ["train", "val", "test"])
