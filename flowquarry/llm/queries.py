"""Queries on the test tables, with SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowquarry.llm import calibrate, mixing, packing, percentiles, textquality
from flowquarry.llm.overlap import near_record_classes, near_record_overlaps, overlap_report
from flowquarry.session import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FEATURES = [
    "Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets",
    "Total Length of Bwd Packets", "Fwd Packet Length Max", "Bwd Packet Length Max", "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Fwd IAT Total", "Bwd PSH Flags", "Fwd Header Length",
    "Packet Length Mean", "Packet Length Std", "Init_Win_bytes_forward", "Init_Win_bytes_backward", "Active Mean", "Idle Mean",
]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- 2: same or near-same records across splits


@query
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = near_record_overlaps(table(spark, sf, "flows"), features=FEATURES)
    return pairs.select(F.least("train_id", "eval_id").alias("flow_id_a"), F.greatest("train_id", "eval_id").alias("flow_id_b"))


@query
def p2_overlap_report(spark: SparkSession, sf: str) -> DataFrame:
    flows = table(spark, sf, "flows")
    report = overlap_report(flows, near_record_classes(flows, features=FEATURES))
    return report.where("split in ('val', 'test')")


@query
def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every flow of the three splits with its class of equal flows and the numbers of linked classes and of partners."""
    return near_record_classes(table(spark, sf, "flows"), features=FEATURES)


# --- 4: sample matching target category proportions


def _flow_categories(spark: SparkSession, sf: str) -> DataFrame:
    families = table(spark, sf, "label_family").select(F.lower(F.trim("label")).alias("norm"), F.col("family").alias("category"))
    flows = table(spark, sf, "flows").select(F.col("flow_id").alias("id"), F.col("source_file").alias("group_key"), calibrate.normalized_label(F.col("label")).alias("norm"))
    return flows.join(F.broadcast(families), "norm").drop("norm")  # one row per label


def _plans(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sample_plan").select("plan_no", F.col("source_file").alias("group_key"), F.col("family").alias("category"), "target_share", "sample_rows", "min_rows")


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_report(spark, sf).where("short").select("plan_no", F.col("category").alias("family"))


_NORM = r"lower(trim(regexp_replace(regexp_replace({}, '[\s\x{{00A0}}]*[–—\x{{FFFD}}\x{{0096}}][\s\x{{00A0}}]*', ' - ', 'g'), '[\s\x{{00A0}}]+', ' ', 'g')))"
SQL["p4_found"] = f"""
with have as (
  select f.source_file, l.family, count(*) as n
  from flows f join label_family l on lower(trim(l.label)) = {_NORM.format('f.label')}
  group by all
)
select p.plan_no, p.family
from sample_plan p left join have h on h.source_file = p.source_file and h.family = p.family
where p.target_share * p.sample_rows > coalesce(h.n, 0) or p.min_rows > coalesce(h.n, 0)
"""


def _sampled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    records = stored(_flow_categories(spark, sf))
    cal = stored(calibrate.calibrated_plans(records, _plans(spark, sf)))
    return cal, calibrate.pivotal_sample(records, cal)


@query
def p4_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(spark, sf)[1]


@query
def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.sample_report(*_sampled(spark, sf))


@query
def p4_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows drawn of each plan: its sample_rows, more where the floors are more, less where the flows are less."""
    return p4_report(spark, sf).groupBy("plan_no").agg(F.sum("drawn").alias("drawn"), F.sum("available").alias("available"))


SQL["p4_sizes"] = f"""
with have as (
  select f.source_file, l.family, count(*) as n
  from flows f join label_family l on lower(trim(l.label)) = {_NORM.format('f.label')}
  group by all
), p as (
  select p.plan_no, p.sample_rows, coalesce(h.n, 0) as n, least(p.min_rows, coalesce(h.n, 0)) as floor, p.target_share
  from sample_plan p left join have h on h.source_file = p.source_file and h.family = p.family
)
select plan_no, cast(greatest(least(max(sample_rows), sum(case when target_share > 0 then n else floor end)), sum(floor)) as bigint) as drawn, cast(sum(n) as bigint) as available
from p group by 1
"""


# --- 7: filling containers

_TOKENS = r"coalesce(len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\p{{Z}}\x1c-\x1f\x85]+')), 0)"


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), table(spark, sf, "containers"))


@query
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf).where("pieces > 1").select("doc_id").distinct()


SQL["p7_found"] = f"""
with d as (select doc_id, lower(trim(lang)) as lang, {_TOKENS.format('text')} as tokens from documents)
select d.doc_id
from d left join containers c on c.lang = d.lang, (select capacity from containers where lang = 'und') u
where d.tokens > coalesce(c.capacity, u.capacity)
"""


@query
def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)


@query
def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packing_report(_packed(spark, sf))


# --- 8: mixing sources


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sized = stored(mixing.sized_documents(table(spark, sf, "documents")))
    rates = stored(mixing.mix_rates(sized, table(spark, sf, "mix_targets")))
    return rates, mixing.mixed_documents(sized, rates)


@query
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(*_mixed(spark, sf)).where("short").select("mix_no", "source")


SQL["p8_found"] = f"""
with s as (select lower(trim(source)) as source, sum({_TOKENS.format('text')}) as tokens from documents where source is not null group by 1)
select m.mix_no, m.source
from mix_targets m left join s on s.source = lower(trim(m.source))
where coalesce(s.tokens, 0) * m.max_repeats < m.target_share * m.total_tokens
"""


@query
def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


@query
def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(*_mixed(spark, sf))


@query
def p8_exhausted(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that fall short, with what the selection reached: all of their tokens as often as allowed."""
    return mixing.mix_report(*_mixed(spark, sf)).where("short").select("mix_no", "source", "documents_used", "tokens_reached")


SQL["p8_exhausted"] = f"""
with d as (select lower(trim(source)) as source, {_TOKENS.format('text')} as tokens from documents where source is not null),
s as (select source, sum(tokens) as tokens, count(*) as n from d where tokens > 0 group by 1)
select m.mix_no, m.source, cast(coalesce(s.n, 0) as bigint) as documents_used, cast(coalesce(s.tokens, 0) * m.max_repeats as bigint) as tokens_reached
from mix_targets m left join s on s.source = lower(trim(m.source))
where coalesce(s.tokens, 0) * m.max_repeats < m.target_share * m.total_tokens
"""


# --- 1: percentiles

MEASURES = ["Flow Bytes/s", "Flow Duration", "Flow IAT Mean"]
PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _states(spark: SparkSession, sf: str) -> DataFrame:
    return percentiles.sketch_states(table(spark, sf, "batch"), {"source": F.col("source"), "day": F.to_date("created_at")}, MEASURES)


@query
def p1_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """By source and day, source, day, and over all; part says which."""
    base = stored(_states(spark, sf))
    none = lambda kind: F.lit(None).cast(kind)
    unions = {"source": {"source": F.col("source"), "day": none("date")}, "day": {"source": none("string"), "day": F.col("day")}, "all": {"source": none("string"), "day": none("date")}}
    out = percentiles.percentiles(base, PROBS).withColumn("part", F.lit("source, day"))
    for part, by in unions.items():
        out = out.unionByName(percentiles.percentiles(percentiles.merge_states(base, by), PROBS).withColumn("part", F.lit(part)))
    return out


@query
def p1_states(spark: SparkSession, sf: str) -> DataFrame:
    return _states(spark, sf)


@query
def p1_first_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """By source, with the rows that were sent again taken out: their sketches are subtracted from those of all rows."""
    batch = table(spark, sf, "batch").select("batch_id", "flow_no", "source", "received_at", *[f"`{m}`" for m in MEASURES])
    order = F.row_number().over(Window.partitionBy("batch_id", "flow_no").orderBy("received_at", "source", *[f"`{m}`" for m in MEASURES]))
    by = {"source": F.col("source")}
    again = batch.withColumn("delivery", order).where("delivery > 1")
    return percentiles.percentiles(percentiles.subtract_states(percentiles.sketch_states(batch, by, MEASURES), percentiles.sketch_states(again, by, MEASURES), ["source"]), PROBS)


@query
def p1_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Per source and measure the counts, and how many of the percentiles lie within their bound of the exact ranks of all rows.

    A percentile at rank k is within its bound if rows of its code, or of codes around it, have ranks from
    k - rank_error to k + rank_error: a rank is off if all values up to the code are too few, or those below too many.
    """
    batch = table(spark, sf, "batch")
    base = percentiles.sketch_states(batch, {"source": F.col("source")}, MEASURES)
    labels = [f"p{100 * p:g}" for p in PROBS]
    est = stored(percentiles.percentiles(base, PROBS))
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"`{m}`").alias("v")) for m in MEASURES])).alias("x")
    counted = batch.select("source", values).select("source", "x.measure", "x.v").where("abs(v) < double('inf')").groupBy("source", "measure", "v").agg(F.count("*").alias("c"))
    e = est.select(F.col("source").alias("s"), F.col("measure").alias("m"), "n", "missing", "non_finite", "rank_error", "value_error", *labels)
    joined = e.join(counted, F.col("s").eqNullSafe(F.col("source")) & (F.col("m") == F.col("measure")), "left")
    near = [(F.abs(F.col(c)) * F.col("value_error") * 1.001, F.col(c)) for c in labels]
    below = [F.coalesce(F.sum(F.when(F.col("v") < x - w, F.col("c"))), F.lit(0)).alias(f"b{i}") for i, (w, x) in enumerate(near)]
    upto = [F.coalesce(F.sum(F.when(F.col("v") <= x + w, F.col("c"))), F.lit(0)).alias(f"u{i}") for i, (w, x) in enumerate(near)]
    sums = joined.groupBy("s", "m", "n", "missing", "non_finite", "rank_error").agg(*below, *upto)
    inside = 0
    for i, p in enumerate(PROBS):
        k = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n") - 1e-9))
        inside = inside + ((F.col(f"b{i}") < k + F.col("rank_error")) & (F.col(f"u{i}") >= k - F.col("rank_error"))).cast("int")
    return sums.where("n > 0").select(F.col("s").alias("source"), F.col("m").alias("measure"), "n", "missing", "non_finite", inside.alias("within_bound"))


SQL["p1_ranks"] = " union all ".join(
    f"""select source, '{m}' as measure, count(*) filter (isfinite("{m}")) as n, count(*) filter ("{m}" is null or isnan("{m}")) as missing,
 count(*) filter (isinf("{m}")) as non_finite, {len(PROBS)} as within_bound from batch group by source having count(*) filter (isfinite("{m}")) > 0"""
    for m in MEASURES
)


# --- 9: text quality


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    return textquality.quality_scores(table(spark, sf, "documents"), table(spark, sf, "doc_labels"), table(spark, sf, "common_words"))


@query
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).where("not_prose >= 0.5").select("doc_id")


@query
def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf)
