"""Queries on the files of raw_lines: schema changes, rejected lines, quality."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.operators import quality, rejects, schemadrift
from flowquarry.plans.registry import Query, collector, table
from flowquarry.session import shared_dir

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
query = collector(QUERIES, SQL)


def _labels(spark: SparkSession, sf: str) -> list[str]:
    """The known labels, normalised; the table is of fixed size."""
    return [r[0] for r in table(spark, sf, "label_family").where("label is not null").select(F.lower(F.trim("label"))).distinct().collect()]


def _files(spark: SparkSession, sf: str, **how: object) -> schemadrift.Files:
    return schemadrift.Files(table(spark, sf, "raw_lines"), table(spark, sf, "filereport"), table(spark, sf, "column_dict"), _labels(spark, sf), **how)


@query()
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return schemadrift.schema_changes(_files(spark, sf, lines=False))


@query()
def p3_unified_schema(spark: SparkSession, sf: str) -> DataFrame:
    return schemadrift.unified_schema(_files(spark, sf, lines=False))


@query()
def p3_unified_rows(spark: SparkSession, sf: str) -> DataFrame:
    return schemadrift.unified_rows(_files(spark, sf, cells=True))


@query()
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.judged_lines(_files(spark, sf)).where("reason is not null and reason <> 'blank'").select("file_no", "line_no", "reason")


@query()
def p5_loaded_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.loaded_rows(_files(spark, sf, cells=True))


@query()
def p5_failing_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The columns whose cells keep a line from loading."""
    return rejects.judged_lines(_files(spark, sf)).where("reason = 'value'").select("file_no", "line_no", F.explode("failing").alias("column_name"))


@query()
def p5_load_balance(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.load_balance(_files(spark, sf), table(spark, sf, "filereport"))


@query()
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_issues(_files(spark, sf, lines=False))


@query()
def p6_by_loads(spark: SparkSession, sf: str) -> DataFrame:
    """The issues from states stored load by load: files loaded in the first half of the time, then the rest added."""
    reports, raw, fields = table(spark, sf, "filereport"), table(spark, sf, "raw_lines"), table(spark, sf, "column_dict")
    labels, path = _labels(spark, sf), f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    loaded = reports.where("file_no is not null").groupBy("file_no").agg(F.min("loaded_at").alias("t"))
    middle = loaded.agg(F.timestamp_micros(F.floor((F.unix_micros(F.min("t")) + F.unix_micros(F.max("t"))) / 2)).alias("m"))
    first = loaded.crossJoin(F.broadcast(middle)).where("t <= m").select("file_no")  # one row
    schemadrift.parse_states(raw.join(first.hint("merge"), "file_no", "left_semi"), fields, labels, lines=False, path=path)
    states = schemadrift.parse_states(raw.join(first.hint("merge"), "file_no", "left_anti"), fields, labels, lines=False, path=path)
    return quality.quality_issues(schemadrift.Files(None, reports, fields, states=states))


@query()
def p6_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return quality.column_profiles(_files(spark, sf, lines=False, hashes=True))


@query(
    """
with r as (select distinct on (file_no, column_name) * from column_stats)
select unnest(['finite_count', 'nan', 'pos_inf', 'neg_inf', 'zeros', 'negatives', 'unparseable', 'min', 'max', 'mean', 'std', 'constant']) as measure,
  count(*) as compared, count(*) as agreeing
from r group by 1
"""
)
def p6_recorded_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Per measure: recorded values, and those that agree with the lines (all, where the records are sound)."""
    both = quality.recorded_comparison(quality.column_profiles(_files(spark, sf, lines=False)), table(spark, sf, "column_stats"))
    return both.groupBy("measure").agg(F.count("*").alias("compared"), F.count_if("agrees").alias("agreeing"))


@query()
def p6_control_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of all number columns that lie outside of the limits of the sensor's earlier files."""
    return quality.control_limits(_files(spark, sf, lines=False), table(spark, sf, "filereport")).where("outside")
