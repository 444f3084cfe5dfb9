"""Replays of recorded flows as micro-batches, and the tables that a scoring stream keeps."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowquarry.operators.metrics import DECISIONS, tally, tally_summary
from flowquarry.operators.serving import schedule
from flowquarry.sources.sinks import write_alerts

#: Most rows that a request holds.
MOST_ROWS = 1000


def recorded_requests(flows: DataFrame, seq: str, folder: str, size: int = MOST_ROWS, limit: int | None = None) -> DataFrame:
    """Write the first ``limit`` rows (all by default) by a dense seq from 0 as requests of ``size`` rows: one file each.

    Returns (request, n, due_rows): the requests with their rows and the rows sent before them. The last one may be
    shorter: a limit may fall inside of a request.
    """
    if not 1 <= size <= MOST_ROWS:
        raise ValueError(f"a request holds 1 to {MOST_ROWS} rows")
    taken = flows if limit is None else flows.where(F.col(seq) < limit)
    numbered = taken.withColumn("request", F.floor(F.col(seq) / size))
    numbered.repartitionByRange("request").sortWithinPartitions("request", seq).write.partitionBy("request").parquet(folder)
    sizes = flows.sparkSession.read.schema(numbered.schema).parquet(folder).groupBy(F.col("request").cast("long").alias("request")).agg(F.count("*").alias("n"))
    return schedule(sizes, "request", "n", 1.0).withColumnRenamed("due", "due_rows")


def send(
    flows: DataFrame,
    seq: str,
    label: str,
    score: Callable[[DataFrame], DataFrame],
    folder: str,
    *,
    size: int = MOST_ROWS,
    rate: float = 0.0,
    limit: int | None = None,
    requests_at_once: int = 16,
    progress: Callable[[int, float], None] | None = None,
    every: float = 5.0,
) -> tuple[DataFrame, dict]:
    """Replay recorded rows as a stream of requests; the decided rows (seq, label, decision), and a report.

    score gets the rows without their label and adds a decision. A trigger takes requests_at_once requests as one job; with
    a rate (rows per second) triggers are as far apart as that many rows need. Rows are decided whole requests at a time
    and written by trigger, so that a repeated trigger replaces its own rows. progress is called with the rows sent and the
    seconds since the beginning. An interrupt ends the stream; the report then covers what was sent.
    """
    spark = flows.sparkSession
    source, decided = f"{folder}/requests", f"{folder}/decided"
    wanted = recorded_requests(flows, seq, source, size, limit).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    types = dict(flows.dtypes)
    schema = f"`{seq}` {types[seq]}, `{label}` {types[label]}, decision string"
    spark.createDataFrame([], schema).write.parquet(f"{decided}/trigger=-1")

    done: dict[int, int] = {}

    def decide(df: DataFrame, trigger: int) -> None:
        rows = df.drop("request").persist()
        try:
            out = score(rows.drop(label)).select(seq, "decision").join(rows.select(seq, label), seq)
            out.select(seq, label, "decision").write.mode("overwrite").parquet(f"{decided}/trigger={trigger}")
            done[trigger] = rows.count()
        finally:
            rows.unpersist()

    began = time.monotonic()
    how = {"processingTime": f"{max(1, round(1000 * size * requests_at_once / rate))} milliseconds"} if rate > 0 else {"availableNow": True}
    stream = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", requests_at_once).parquet(source)
    run = stream.writeStream.foreachBatch(decide).option("checkpointLocation", f"{folder}/checkpoint").trigger(**how).start()
    ending = "limit reached" if limit is not None else "finished"
    last = began
    try:
        while run.isActive and sum(done.values()) < wanted:
            run.awaitTermination(0.1)
            if progress is not None and time.monotonic() - last >= every:
                last = time.monotonic()
                progress(sum(done.values()), last - began)
        if rate <= 0:
            run.awaitTermination()
    except KeyboardInterrupt:
        ending = "interrupted"
    finally:
        run.stop()
    if run.exception() is not None:
        raise run.exception()
    rows = spark.read.schema(schema).parquet(decided).select(seq, label, "decision")
    return rows, replay_report(rows, label, ending, time.monotonic() - began)


def replay_report(decided: DataFrame, label: str, ending: str, seconds: float, benign: str = "BENIGN") -> dict:
    """Rows sent and rate reached, decisions by label, and rates by what counts as an alert; null where nothing can be said."""
    table = tally(decided, F.col(label), F.col("decision")).collect()  # one row per label
    sent = sum(r[d] for r in table for d in DECISIONS)
    known = F.when(F.col(label).isNotNull(), F.col(label) != benign)
    rates = {r["alerts"]: {c: r[c] for c in ("recall", "fpr", "precision")} for r in tally_summary(decided, known, F.col("decision")).collect()}
    return {"ending": ending, "sent": sent, "seconds": seconds, "rows_per_second": sent / seconds if seconds > 0 else None, "decisions": {r["label"]: {d: r[d] for d in DECISIONS} for r in table}, **rates}


def scoring_sink(predictions: str, alerts: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the scored rows, and the alerts without features, each in a folder of the batch.

    A repeated batch replaces its own rows in both.
    """

    def write(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            df.write.mode("overwrite").parquet(f"{predictions}/batch={batch}")
            write_alerts(df, f"{alerts}/batch={batch}")
        finally:
            df.unpersist()

    return write


def event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """df with ts as a timestamp and a watermark (timestamp_ntz carries none)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def tumbling(df: DataFrame, ts: str, width: str, by: Sequence[str], aggs: Sequence[Column], slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) windows over event time."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    got = df.groupBy(w.alias("w"), *by).agg(*aggs)
    return got.select(F.col("w.start").alias("window_start"), *by, *[c for c in got.columns if c not in ("w", *by)])


def sessions(df: DataFrame, ts: str, gap: str, by: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Sessions that end after a gap of event time."""
    got = df.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*aggs)
    return got.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, *[c for c in got.columns if c not in ("w", *by)])


def first_copies(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stream without rows whose keys came before within the watermark."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def bottom_k_stream(df: DataFrame, stratum: str, key: str, k: int) -> DataFrame:
    """(stratum, keys): the k smallest keys of each stratum so far, as state that stays of bounded size."""

    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for f in frames:
            held = sorted(set(held) | set(f[key]))[:k]
        state.update((held,))
        yield pd.DataFrame({stratum: [name[0]], "keys": [held]})

    types = dict(df.dtypes)
    return df.groupBy(stratum).applyInPandasWithState(update, f"{stratum} {types[stratum]}, keys array<{types[key]}>", f"keys array<{types[key]}>", "update", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, mode: str, folder: str, timeout: int = 300) -> DataFrame:
    """Run a stream over what is there now; its rows as Parquet below folder (in complete mode those of the last trigger)."""
    out = f"{folder}/rows"
    empty = df.sparkSession.createDataFrame([], df.schema)
    empty.write.mode("overwrite").parquet(f"{out}/trigger=-1")

    def write(rows: DataFrame, trigger: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/trigger={-1 if mode == 'complete' else trigger}")

    run = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        run.awaitTermination(timeout)
        if run.isActive:
            raise TimeoutError(f"the stream did not end within {timeout} s")
    finally:
        run.stop()
    return df.sparkSession.read.schema(df.schema).parquet(out).select(*df.columns)
