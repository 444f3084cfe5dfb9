"""Session factory and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "flowquarry", cpus: int | str = "*", **conf: object) -> SparkSession:
    """A local session with the settings that the operators are written for (UTC, AQE on, ANSI left on)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k: str(v) for k, v in conf.items()}
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Only a local session without that setting gets a folder of its own; on a cluster a missing setting is an
    error, as a machine-local folder would lose data with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(named)
        return named
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "flowquarry-checkpoints")
    spark.sparkContext.setCheckpointDir(own)
    return own


_written: list[str] = []


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back: cuts the lineage and survives lost executors.

    With by there is a folder (by=value) for each value of these columns. The table stays until ``release``, as results are read later than queries are built.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    _written.append(path)
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table that ``stored`` gave as df, when nothing reads it any more."""
    at = df.inputFiles()
    for path in [p for p in _written if any(f"/{os.path.basename(p)}/" in f for f in at)]:
        target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _written.remove(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that this process has stored. Results that read them can't be read any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _release_at_exit() -> None:
    context = SparkContext._active_spark_context
    if _written and context is not None and context._jsc is not None:
        try:
            release(SparkSession(context))
        except Exception:  # noqa: BLE001  # the JVM may be gone; the folder is the cluster's to clean then
            pass
