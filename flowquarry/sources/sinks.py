"""Writing results: clean tables, alert logs, small reports and request bodies."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.scalars import q
from flowquarry.operators.sampling import stratified_sample


def write_clean(df: DataFrame, path: str, features: Sequence[str], *, by: str | None = "split") -> None:
    """Features as float32, Parquet with zstd, a folder per split so that reading one split reads only it."""
    cast = [q(c).cast("float").alias(c) if c in features else q(c) for c in df.columns]
    w = df.select(*cast).write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(by) if by else w).parquet(path)


def load_split(spark, path: str, split: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One split with the columns wanted; only its folder and these columns are read."""
    df = spark.read.parquet(path).where(F.col("split") == split)
    return df.select(*[q(c) for c in columns]) if columns else df


def write_alerts(df: DataFrame, path: str, hidden: Sequence[str] = ("features", "explanation")) -> None:
    """Records that aren't benign, as JSON lines without their features; what stood in path before is replaced."""
    df.where("decision <> 'benign'").drop(*hidden).write.mode("overwrite").json(path)


def append_alerts(df: DataFrame, path: str, hidden: Sequence[str] = ("features", "explanation")) -> None:
    """The same, beside what is there."""
    df.where("decision <> 'benign'").drop(*hidden).write.mode("append").json(path)


def access_log(df: DataFrame, path: str, at: str, source: str, decision: str) -> None:
    """One JSON line per decision: time, source, decision and nothing of the features."""
    df.select(F.col(at).alias("time"), F.coalesce(source, F.lit("unknown")).alias("source"), F.col(decision).alias("decision")).write.mode("append").json(path)


def rewrite_with(df: DataFrame, path: str, **columns: Column) -> None:
    """df with more (or replaced) columns as Parquet in another folder than the one it was read from."""
    df.withColumns(columns).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_sample(df: DataFrame, path: str, stratum: Column, most: int, key: Column) -> None:
    """At most ``most`` rows of each stratum, the first by key, as Parquet."""
    stratified_sample(df, stratum, most, key).write.mode("overwrite").parquet(path)


def plain_json(x: object) -> object:
    """A value for JSON: NaN and infinities are null, all the way down."""
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dict):
        return {str(k): plain_json(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain_json(v) for v in x]
    return x


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file at path, on any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """The small text file at path."""
    return bytes(spark.read.format("binaryFile").load(path).first()["content"]).decode()


def number(x: float | int | None) -> float | int | None:
    """A JSON number: whole if it is, null if it is none."""
    if x is None or not math.isfinite(x):
        return None
    return int(x) if float(x).is_integer() else float(x)


def example_bodies(df: DataFrame, label: str, features: Sequence[str], order: str) -> dict[str, dict]:
    """One request body per label: its first row by order."""
    rows = df.groupBy(label).agg(F.min_by(F.struct(*[q(c).cast("double").alias(c) for c in features]), order).alias("x")).collect()  # one row per label
    return {r[0]: {"features": {c: number(r["x"][c]) for c in features}} for r in rows if r[0] is not None}


def cell(x: object) -> str:
    """A cell of a Markdown table: thousands separated, four significant digits, pipes escaped."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, int):
        return f"{x:,}"
    if isinstance(x, float):
        return f"{x:.4g}"
    return str(x).replace("|", "\\|")


def markdown_table(rows: Sequence[Sequence[object]], header: Sequence[str]) -> str:
    lines = ["| " + " | ".join(header) + " |", "|" + "---|" * len(header)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])


def write_report(tables: dict[str, DataFrame], folder: str, summary: dict | None = None, most: int = 10_000) -> None:
    """Small result tables as one CSV each, and summary.json. Tables of more rows are an error: they belong in Parquet."""
    os.makedirs(folder, exist_ok=True)
    for name, df in tables.items():
        got = df.limit(most + 1).toPandas()
        if len(got) > most:
            raise ValueError(f"{name} has more than {most} rows; write it as Parquet")
        got.to_csv(os.path.join(folder, f"{name}.csv"), index=False)
    if summary is not None:
        with open(os.path.join(folder, "summary.json"), "w") as f:
            json.dump(plain_json(summary), f, indent=1, default=str)


def offline_reports(folder: str, expected: dict[str, str]) -> dict:
    """The reports that are there, by name, and the names of those that aren't; JSON, or CSV with sniffed cells."""
    import csv

    out: dict = {"missing": []}
    for name, file in expected.items():
        path = os.path.join(folder, file)
        if not os.path.exists(path):
            out[name] = None
            out["missing"].append(name)
        elif file.endswith(".json"):
            with open(path) as f:
                out[name] = json.load(f)
        else:
            with open(path, newline="") as f:
                out[name] = [{k: sniff(v) for k, v in r.items()} for r in csv.DictReader(f)]
    return out


def sniff(text: str) -> object:
    try:
        return float(text) if any(c in text.lower() for c in ".e") else int(text)
    except ValueError:
        return text
