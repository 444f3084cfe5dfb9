"""Queries on flows and batch: profiles, duplicates, splits, metrics, decisions, serving tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.functions.scalars import canonical_label, family_of, normalized_label, q
from flowquarry.operators import correlation, duplicates, features, metrics, orderstats, profile, requests, sampling, serving
from flowquarry.plans.registry import Query, collector, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
query = collector(QUERIES, SQL)

FEATURES = [
    "Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets",
    "Total Length of Bwd Packets", "Fwd Packet Length Max", "Bwd Packet Length Max", "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Fwd IAT Total", "Bwd PSH Flags", "Fwd Header Length",
    "Packet Length Mean", "Packet Length Std", "Init_Win_bytes_forward", "Init_Win_bytes_backward", "Active Mean", "Idle Mean",
]

_X = 'cast("{}" as double)'
_CELLS = "\n  union all ".join(f"select source_file, label, split, flow_id, is_attack, '{c}' as column_name, {_X.format(c)} as value from flows" for c in FEATURES)
_FIN = "isfinite(value)"
_CANON = ", ".join(f"case when isnan({_X.format(c)}) then null else {_X.format(c)} end" for c in FEATURES)
_NORM = r"trim(regexp_replace(regexp_replace({}, '[\s\x{{00A0}}]*[–—\x{{FFFD}}\x{{0096}}][\s\x{{00A0}}]*', ' - ', 'g'), '[\s\x{{00A0}}]+', ' ', 'g'))"


def _flows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "flows")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Flows with reproducible scores p and a, made from their ids."""
    f = _flows(spark, sf).select("flow_id", "label", "family", "is_attack", "source_file", "split")
    return f.withColumn("p", (F.col("flow_id") * 7919 % 1000 + 300 * F.col("is_attack")) / F.lit(1300.0)).withColumn("a", (F.col("flow_id") * 104729 % 997) / F.lit(997.0))


_SCORED = "(select flow_id, label, family, is_attack, source_file, split, (flow_id * 7919 % 1000 + 300 * is_attack) / 1300.0::double as p, (flow_id * 104729 % 997) / 997.0::double as a from flows)"


# --- profiles

_MEASURES = f"""count(*) filter (where {_FIN}) as finite_count, count(*) filter (where value is null or isnan(value)) as nan,
  count(*) filter (where value = 'infinity'::double) as pos_inf, count(*) filter (where value = '-infinity'::double) as neg_inf,
  round(avg(value) filter (where {_FIN}), 3) as mean, round(stddev_samp(value) filter (where {_FIN}), 3) as std,
  min(value) filter (where {_FIN}) as min, max(value) filter (where {_FIN}) as max,
  count(*) filter (where value = 0) as zeros, count(*) filter (where {_FIN} and value < 0) as negatives,
  coalesce(min(value) filter (where {_FIN}) = max(value) filter (where {_FIN}), false) as constant"""


@query(f"select column_name, {_MEASURES} from ({_CELLS}) group by 1")
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    got = profile.column_profile(_flows(spark, sf), FEATURES)
    return got.withColumn("mean", F.round("mean", 3)).withColumn("std", F.round("std", 3))


@query(f"""select source_file, column_name, count(*) filter (where value is null or isnan(value)) as nan,
  count(*) filter (where value = 'infinity'::double) as pos_inf, count(*) filter (where value = '-infinity'::double) as neg_inf,
  cast(grouping(source_file) as integer) as over_all
from ({_CELLS}) group by grouping sets ((source_file, column_name), (column_name))""")
def file_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.file_and_total_profile(_flows(spark, sf), FEATURES, "source_file")


@query("""select source_file, label, n, case when g = 1 then round(100.0::double * n / (select count(*) from flows), 4) end as pct
from (select source_file, coalesce(label, '<missing>') as label, count(*) as n, grouping(source_file) as g from flows
      group by grouping sets ((source_file, coalesce(label, '<missing>')), (coalesce(label, '<missing>'))))""")
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return profile.label_distribution(_flows(spark, sf), F.col("label"), F.col("source_file"))


_COPIES = [*FEATURES, "Destination Port copy", "Fwd Header Length.1"]
_WITH_COPIES = """(select *, "Destination Port" as "Destination Port copy", case when isnan("Fwd Header Length") then null else "Fwd Header Length" end as "Fwd Header Length.1" from flows)"""
_EQUAL = lambda x, c: f"case when {x}.\"{c}\" is null or isnan({x}.\"{c}\") then null else {x}.\"{c}\"::double end"


@query("\nunion all ".join(f"select '{a}' as column_a, '{b}' as column_b from {_WITH_COPIES} t having count(*) > 0 and bool_and({_EQUAL('t', a)} is not distinct from {_EQUAL('t', b)})" for i, a in enumerate(_COPIES) for b in _COPIES[i + 1 :]))
def identical_columns(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of the features and of two columns that repeat one of them (missing cells in either spelling are equal)."""
    again = F.when(~F.isnan(q("Fwd Header Length")), q("Fwd Header Length"))
    f = _flows(spark, sf).withColumn("Destination Port copy", q("Destination Port")).withColumn("Fwd Header Length.1", again)
    return profile.identical_columns(f, _COPIES)


@query("""with n as (select column_name, replace(lower(column_name), '_', ' ') as t from column_dict union all select trim(c), replace(lower(trim(c)), '_', ' ') from (select distinct unnest(columns) as c from filereport))
select distinct column_name, case when t in ('flow id', 'flowid') then 'flow id' when t in ('time stamp', 'timestamp') then 'timestamp' when t = 'protocol' then 'protocol' when t like '%ip' then 'ip address' else 'port' end as kind
from n where t in ('flow id', 'flowid', 'time stamp', 'timestamp', 'protocol') or (case when contains(t, ' ') then t else ' ' || t end) similar to '(.* )?(src|source|dst|destination) ?(ip|port)'
  or t similar to '(src|source|dst|destination) ?(ip|port)'""")
def identifier_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Of the dictionary's names and all names that files have."""
    listed = table(spark, sf, "column_dict").select("column_name")
    found = table(spark, sf, "filereport").select(F.explode("columns").alias("column_name")).select(F.trim("column_name"))
    names = [r[0] for r in listed.union(found).distinct().collect()]  # different names
    return spark.createDataFrame(list(profile.identifier_columns(names).items()), "column_name string, kind string")


@query("""select label, sum(case when source_file like 'Monday%' then 1 else 0 end)::bigint as monday, sum(case when source_file like 'Tuesday%' then 1 else 0 end)::bigint as tuesday,
  sum(case when source_file like 'Wednesday%' then 1 else 0 end)::bigint as wednesday, sum(case when source_file like 'Thursday%' then 1 else 0 end)::bigint as thursday,
  sum(case when source_file like 'Friday%' then 1 else 0 end)::bigint as friday from flows group by 1""")
def label_by_day(spark: SparkSession, sf: str) -> DataFrame:
    days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]
    d = _flows(spark, sf).withColumn("day", F.regexp_extract("source_file", f"^({'|'.join(days)})", 1))
    got = d.groupBy("label").pivot("day", days).count().na.fill(0, days)
    return got.select("label", *[F.col(x).alias(x.lower()) for x in days])


# --- labels

_LABELS = f"(select f.*, lf.label as canonical_label, lf.family as canonical_family from flows f left join label_family lf on lower(lf.label) = lower({_NORM.format('f.label')}))"


@query(f"""select canonical_label, canonical_family, case when canonical_label is null then -1 when canonical_label = 'BENIGN' then 0 else 1 end as is_attack_label, count(*) as n
from {_LABELS} group by all""")
def label_normalize(spark: SparkSession, sf: str) -> DataFrame:
    f = _flows(spark, sf).select(canonical_label(F.col("label"), unknown="null").alias("canonical_label"))
    f = f.withColumn("canonical_family", family_of(F.col("canonical_label"), unknown="null"))
    return f.withColumn("is_attack_label", F.when(F.col("canonical_label").isNull(), -1).when(F.col("canonical_label") == "BENIGN", 0).otherwise(1)).groupBy("canonical_label", "canonical_family", "is_attack_label").agg(F.count("*").alias("n"))


@query(f"select flow_id, family, canonical_family from {_LABELS} where canonical_family is distinct from family")
def family_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    dim = table(spark, sf, "label_family").select(F.lower("label").alias("norm"), F.col("family").alias("canonical_family"))
    f = _flows(spark, sf).select("flow_id", "family", F.lower(normalized_label(F.col("label"))).alias("norm"))
    j = f.join(F.broadcast(dim), "norm", "left")  # one row per label
    return j.where(~F.col("canonical_family").eqNullSafe(F.col("family"))).select("flow_id", "family", "canonical_family")


# --- duplicates

_KEYS = f"(select row({_CANON}) as v, label, source_file as file, flow_id from flows)"


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.keyed(_flows(spark, sf), FEATURES, F.col("label"), F.col("source_file"), F.col("flow_id"))


@query(f"""with k as {_KEYS}, g as (select v, label, file, count(*) as n from k group by all),
  a as (select (select count(*) from k) as t, (select count(*) from (select distinct v, label from k)) as u, (select count(*) from g) as w, (select count(*) from (select distinct v from k)) as vec)
select t as row_count, t - u as exact_duplicates, t - w as within_files, (t - u) - (t - w) as across_files, u as unique_rows, vec as unique_vectors from a""")
def duplicate_summary(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.duplicate_summary(_keys(spark, sf))


@query(f"""with k as {_KEYS}, g as (select v, label, count(*) as n from k group by all)
select label, sum(n)::bigint as row_count, (sum(n) - count(*))::bigint as redundant, round(100.0::double * (sum(n) - count(*)) / sum(n), 2) as pct from g group by 1""")
def duplicates_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.redundant_by(_keys(spark, sf), "label")


@query(f"""with k as {_KEYS}, g as (select v, label, file, count(*) as n from k group by all)
select file, sum(n)::bigint as row_count, (sum(n) - count(*))::bigint as redundant, round(100.0::double * (sum(n) - count(*)) / sum(n), 2) as pct from g group by 1""")
def duplicates_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.redundant_by(_keys(spark, sf), "file")


@query(f"""with k as {_KEYS}, s as (select v, string_agg(distinct coalesce(label, '<missing>'), ' | ' order by coalesce(label, '<missing>')) as labels, count(distinct coalesce(label, '<missing>')) as c, count(*) as n from k group by 1)
select labels, count(*) as vectors, sum(n)::bigint as row_count from s where c > 1 group by 1""")
def conflicting_label_sets(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.conflicting_label_sets(_keys(spark, sf))


@query(f"""with k as {_KEYS} select flow_id, label from k where v in (select v from k group by v having count(distinct coalesce(label, '<missing>')) > 1)""")
def conflicting_rows(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.conflicting_rows(_keys(spark, sf)).select("flow_id", "label")


@query(f"""with k as {_KEYS}, r as (select *, row_number() over (partition by v, label order by file, flow_id) as rn from k)
select flow_id from r where rn = 1""")
def dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.keep_first(_flows(spark, sf), FEATURES, F.col("label"), [F.col("source_file"), F.col("flow_id")]).select("flow_id")


@query(f"""with k as {_KEYS}, r as (select *, row_number() over (partition by v, label order by file, flow_id) as rn from k)
select file as source_file, count(*) as rows_in, count(*) filter (where rn = 1) as rows_out, count(*) filter (where rn > 1) as removed from r group by 1""")
def dedup_report(spark: SparkSession, sf: str) -> DataFrame:
    f = _flows(spark, sf)
    return duplicates.removal_report(f, duplicates.keep_first(f, FEATURES, F.col("label"), [F.col("source_file"), F.col("flow_id")]), F.col("source_file"), "source_file")


# --- samples and splits

_MD5 = "md5('42|' || flow_id::varchar)"


@query(f"""with r as (select label, row_number() over (partition by label order by {_MD5}) as rn, count(*) over (partition by label) as n from flows),
  s as (select label, case when rn <= floor(0.7::double * n + 0.5) then 'train' when rn <= floor(0.7::double * n + 0.5) + ceil((n - floor(0.7::double * n + 0.5)) / 2) then 'val' else 'test' end as split from r)
select label, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'val') as val, count(*) filter (where split = 'test') as test from s group by 1""")
def stratified_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    f = _flows(spark, sf).select("flow_id", "label")
    return sampling.split_table(sampling.stratified_split(f, F.col("label"), sampling.order_key("42", F.col("flow_id"))), "label")


@query(f"select flow_id, label from (select flow_id, label, row_number() over (partition by label order by {_MD5}) as rn from flows) where rn <= 20")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    f = _flows(spark, sf).select("flow_id", "label")
    return sampling.stratified_sample(f, F.col("label"), 20, sampling.order_key("42", F.col("flow_id")))


@query(f"select flow_id, label from flows order by {_MD5} limit 100")
def bottom_k_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.bottom_k(_flows(spark, sf).select("flow_id", "label"), 100, sampling.order_key("42", F.col("flow_id")))


@query("select flow_id, cast(\"Flow Duration\" as double) as duration from flows where split = 'val'")
def load_split(spark: SparkSession, sf: str) -> DataFrame:
    return _flows(spark, sf).where("split = 'val'").select("flow_id", q("Flow Duration").cast("double").alias("duration"))


@query("select count(*) as shared from (select flow_id from flows where split = 'train' intersect select flow_id from flows where split <> 'train')")
def split_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    f = _flows(spark, sf)
    return f.where("split = 'train'").select("flow_id").intersect(f.where("split <> 'train'").select("flow_id")).agg(F.count("*").alias("shared"))


@query("select split, count(*) as n, count(*) filter (where is_attack = 1) as attacks from flows group by 1")
def split_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _flows(spark, sf).groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("is_attack") == 1).alias("attacks"))


# --- learned preprocessing


@query(f"select column_name, round(quantile_cont(value, 0.5), 4) as median from ({_CELLS}) where {_FIN} and split = 'train' group by 1")
def feature_medians(spark: SparkSession, sf: str) -> DataFrame:
    return features.medians(_flows(spark, sf).where("split = 'train'"), FEATURES).withColumn("median", F.round("median", 4))


_KEPT = [c for c in FEATURES if c != "Destination Port"]
_N = range(len(_KEPT))


@query(f"""with d as (select flow_id, split, {', '.join(f'case when isfinite({_X.format(c)}) then {_X.format(c)} end as x{i}' for i, c in enumerate(_KEPT))} from flows),
  q as (select {', '.join(f'quantile_cont(x{i}, 0.5) as m{i}, count(x{i}) = 0 or (count(x{i}) = count(*) and min(x{i}) = max(x{i})) as k{i}' for i in _N)} from d where split = 'train'),
  f as (select flow_id, split, {', '.join(f'coalesce(x{i}, m{i}) as x{i}' for i in _N)} from d, q),
  l as materialized (select flow_id, split, {', '.join(f'sign(x{i}) * ln(1 + abs(x{i})) as x{i}' for i in _N)} from f),
  s as materialized (select {', '.join(f'avg(x{i}) as a{i}, stddev_pop(x{i}) as s{i}' for i in _N)} from l where split = 'train')
select flow_id, {', '.join(f'case when not k{i} then round((x{i} - a{i}) / case when s{i} = 0 then 1 else s{i} end, 5) + 0.0::double end as "{c}"' for i, c in enumerate(_KEPT))} from l, s, q where split = 'test'""")
def feature_scale(spark: SparkSession, sf: str) -> DataFrame:
    """All features but the excluded one, as a model that scales gets them; null for a column that is constant in train."""
    f = _flows(spark, sf)
    p = features.fit_preprocessor(f.where("split = 'train'"), FEATURES, scale=True)
    out = p.transform(f.where("split = 'test'"), ["flow_id"])
    return out.select("flow_id", *[(F.round(q(c), 5) + F.lit(0.0) if c in p.kept else F.lit(None).cast("double")).alias(c) for c in _KEPT])


_DROPS = [*FEATURES, "Flow Duration copy", "Always 3"]
_WITH_DROPS = """(select *, "Flow Duration" as "Flow Duration copy", 3.0::float as "Always 3" from flows where split = 'train')"""
_FINITE = lambda c: f"case when isfinite(\"{c}\") then \"{c}\"::double end"


@query(
    "with t as "
    + _WITH_DROPS
    + ", k as ("
    + "\nunion all ".join(f"select {i} as i, '{c}' as column_name, count({_FINITE(c)}) = 0 or (count({_FINITE(c)}) = count(*) and min({_FINITE(c)}) = max({_FINITE(c)})) as constant from t" for i, c in enumerate(_DROPS))
    + "), e as ("
    + "\nunion all ".join(f"select {i} as a, {j} as b from t having bool_and({_FINITE(_DROPS[i])} is not distinct from {_FINITE(_DROPS[j])})" for i in range(len(_DROPS)) for j in range(i + 1, len(_DROPS)))
    + """)
select column_name, 'constant' as why from k where constant
union all select y.column_name, 'copy of ' || arg_min(x.column_name, x.i) from e join k x on x.i = e.a join k y on y.i = e.b where not x.constant and not y.constant group by y.column_name"""
)
def feature_drops(spark: SparkSession, sf: str) -> DataFrame:
    """Constant and repeated columns among all features and two columns made for it."""
    f = _flows(spark, sf).where("split = 'train'").withColumn("Flow Duration copy", q("Flow Duration")).withColumn("Always 3", F.lit(3.0))
    constant, copies = features.uninformative(f, _DROPS)
    return spark.createDataFrame([(c, "constant") for c in constant] + [(c, f"copy of {o}") for c, o in copies.items()], "column_name string, why string")


# --- correlations, histograms, box plots

_ALL_PAIRS = "\n  union all ".join(f"select '{a}' as column_a, '{b}' as column_b, {_X.format(a)} as a, {_X.format(b)} as b from flows" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :])


@query(f"""select * from (select column_a, column_b, round(corr(a, b), 6) as r, count(*) as n from ({_ALL_PAIRS}) where isfinite(a) and isfinite(b) group by 1, 2 having count(*) >= 30)
where not isnan(r) and abs(r) >= 0.5""")
def correlated_pairs_all(spark: SparkSession, sf: str) -> DataFrame:
    """Of all 231 pairs of the features."""
    return correlation.correlations(_flows(spark, sf), FEATURES).withColumn("r", F.round("r", 6)).where(F.abs("r") >= 0.5)


@query(f"""select * from (select column_a, column_b, round(corr(a, b), 6) as r, count(*) as n from ({_ALL_PAIRS}) where isfinite(a) and isfinite(b) group by 1, 2 having count(*) >= 30)
where not isnan(r) and abs(r) >= 0.95 order by abs(r) desc, column_a, column_b limit 25""")
def correlated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 strongest pairs of all features from 0.95 on, the strongest first."""
    return correlated_pairs_all(spark, sf).where(F.abs("r") >= 0.95).orderBy(F.abs("r").desc(), "column_a", "column_b").limit(25)


@query(f"""with d as (select is_attack as class, sign(x) * log10(1 + abs(x)) as x from (select is_attack, {_X.format('Flow Duration')} as x from flows) where isfinite(x)),
  e as (select min(x) as lo, max(x) as hi from d), b as (select class, least(39, floor((x - lo) / ((hi - lo) / 40)))::bigint as bin, (hi - lo) / 40 as width from d, e)
select class, bin, count(*) as n, round(count(*) / (sum(count(*)) over (partition by class) * any_value(width)), 6) as density from b group by class, bin""")
def signed_log_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return correlation.signed_log_histogram(_flows(spark, sf), "Flow Duration", F.col("is_attack")).withColumn("density", F.round("density", 6))


@query(f"""with d as (select label, {_X.format('Flow Duration')} as v from flows where isfinite("Flow Duration")),
  q as (select label, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3 from d group by 1)
select q.label, round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3, min(v) filter (where v >= q1 - 1.5 * (q3 - q1)) as low, max(v) filter (where v <= q3 + 1.5 * (q3 - q1)) as high
from d join q on d.label is not distinct from q.label group by all""")
def box_plot_statistics(spark: SparkSession, sf: str) -> DataFrame:
    got = correlation.box_plot(_flows(spark, sf), "label", "Flow Duration")
    return got.select("label", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "low", "high")


@query(f"""select column_name from (select column_name, stddev_samp(value) filter (where {_FIN}) as s, min(value) filter (where {_FIN}) <> max(value) filter (where {_FIN}) as varies,
  case column_name when 'Flow Duration' then 0 when 'Flow Bytes/s' then 1 else 9 end as rank from ({_CELLS}) group by 1) where varies order by rank, s desc, column_name limit 12""")
def plotted_features(spark: SparkSession, sf: str) -> DataFrame:
    p = profile.column_profile(_flows(spark, sf), FEATURES).where("not constant and finite_count > 0")
    rank = F.when(F.col("column_name") == "Flow Duration", 0).when(F.col("column_name") == "Flow Bytes/s", 1).otherwise(9)
    return p.orderBy(rank, F.desc("std"), "column_name").limit(12).select("column_name")


# --- metrics


@query(f"""with c as (select count(*) filter (where is_attack = 0 and p < 0.5) as tn, count(*) filter (where is_attack = 0 and p >= 0.5) as fp, count(*) filter (where is_attack = 1 and p < 0.5) as fn, count(*) filter (where is_attack = 1 and p >= 0.5) as tp from {_SCORED})
select tn, fp, fn, tp, round((tp + tn) / (tn + fp + fn + tp)::double, 6) as accuracy, round(tp / (tp + fp)::double, 6) as precision, round(tp / (tp + fn)::double, 6) as recall, round(2 * tp / (2 * tp + fp + fn)::double, 6) as f1, round(fp / (fp + tn)::double, 6) as fpr from c""")
def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.rates(metrics.confusion(_scored(spark, sf), F.col("is_attack"), F.col("p") >= 0.5))
    return got.select("tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "fpr")])


@query(f"""with s as (select p, is_attack as y from {_SCORED} where p is not null), g as (select p, count(*) as n, sum(y)::bigint as tp from s group by 1),
  w as (select *, sum(n) over (order by p desc) as cn, sum(tp) over (order by p desc) as ct, sum(n - tp) over (order by p) as below from g),
  t as (select sum(tp)::double as pos, sum(n - tp)::double as neg, sum(tp * (below - (n - tp)) + tp * (n - tp) / 2.0::double) as won, sum(tp * (ct::double / cn)) as steps from w)
select pos::bigint as positives, neg::bigint as negatives, round(won / (pos * neg), 8) as roc_auc, round(steps / pos, 8) as average_precision from t""")
def roc_auc_and_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.ranking_metrics(_scored(spark, sf), F.col("is_attack"), F.col("p"))
    return got.select("positives", "negatives", F.round("roc_auc", 8).alias("roc_auc"), F.round("average_precision", 8).alias("average_precision"))


@query(f"select label, count(*) as row_count, count(*) filter (where p >= 0.5) as flagged, round(count(*) filter (where p >= 0.5) / count(*)::double, 6) as rate from {_SCORED} group by 1")
def per_label_rates(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.per_label_rates(_scored(spark, sf), F.col("label"), F.col("p") >= 0.5).withColumn("rate", F.round("rate", 6))


_THRESHOLD = f"(select quantile_cont(a, 0.95) from {_SCORED} where split = 'val' and is_attack = 0)"


@query(f"""select 0.01::double as target_fpr, round(quantile_cont(a, 0.99), 8) as threshold from {_SCORED} where split = 'val' and is_attack = 0
union all select 0.05::double, round({_THRESHOLD}, 8)""")
def threshold_for_fpr(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf).where("split = 'val' and is_attack = 0")
    return metrics.threshold_for_fpr(s, "a", [0.01, 0.05]).withColumn("threshold", F.round("threshold", 8))


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    t = metrics.threshold_for_fpr(s.where("split = 'val' and is_attack = 0"), "a", [0.05]).select("threshold")
    return s.where("split = 'test'").crossJoin(F.broadcast(t)).withColumn("decision", metrics.hybrid_decision(F.col("p"), F.col("a"), F.col("threshold")))  # one threshold


_DECIDED = f"(select *, case when p >= 0.5 then 'known_attack' when a >= {_THRESHOLD} then 'anomaly' else 'benign' end as decision from {_SCORED} where split = 'test')"


@query(f"select flow_id, decision from {_DECIDED}")
def hybrid_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf).select("flow_id", "decision")


@query(f"select d.decision, count(flow_id) as n from (values ('benign'), ('anomaly'), ('known_attack')) d(decision) left join {_DECIDED} using (decision) group by 1")
def hybrid_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.decision_counts(_decided(spark, sf), F.col("decision"))


@query(f"""select label, count(*) filter (where decision = 'benign') as benign, count(*) filter (where decision = 'anomaly') as anomaly, count(*) filter (where decision = 'known_attack') as known_attack from {_DECIDED} group by 1""")
def decision_tally(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.tally(_decided(spark, sf), F.col("label"), F.col("decision"))


@query(f"""with c as (select 'known_attack_only' as alerts, is_attack as y, decision = 'known_attack' as f from {_DECIDED} union all select 'any_alert', is_attack, decision <> 'benign' from {_DECIDED}),
  n as (select alerts, count(*) filter (where y = 0 and not f) as tn, count(*) filter (where y = 0 and f) as fp, count(*) filter (where y = 1 and not f) as fn, count(*) filter (where y = 1 and f) as tp from c group by 1)
select alerts, tn, fp, fn, tp, round(tp / nullif(tp + fn, 0)::double, 6) as recall, round(fp / nullif(fp + tn, 0)::double, 6) as fpr, round(tp / nullif(tp + fp, 0)::double, 6) as precision from n""")
def tally_summary(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.tally_summary(_decided(spark, sf), F.col("is_attack"), F.col("decision"))
    return got.select("alerts", "tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in ("recall", "fpr", "precision")])


@query(f"""with h as (select distinct family as held from flows where family <> 'BENIGN'), s as (select *, (flow_id * 31 + length(held) * 17) % 100 >= 60 as c from {_SCORED}, h where split = 'test')
select held, round(avg(c::int) filter (where family = held), 6) as classifier_held_out_recall, round(avg(c::int) filter (where is_attack = 1 and (family <> held or family is null)), 6) as classifier_seen_recall, round(avg(c::int) filter (where is_attack = 0), 6) as classifier_fpr,
  round(avg((c or a >= 0.95)::int) filter (where family = held), 6) as hybrid_held_out_recall, round(avg((c or a >= 0.95)::int) filter (where is_attack = 1 and (family <> held or family is null)), 6) as hybrid_seen_recall, round(avg((c or a >= 0.95)::int) filter (where is_attack = 0), 6) as hybrid_fpr
from s group by 1""")
def lofo_recall(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    held = F.broadcast(s.where("family <> 'BENIGN'").select(F.col("family").alias("held")).distinct())  # one row per family
    c = (F.col("flow_id") * 31 + F.length("held") * 17) % 100 >= 60
    long = s.where("split = 'test'").crossJoin(held)
    got = metrics.held_out_rates(long, "held", F.col("family"), F.col("is_attack"), {"classifier": c, "hybrid": c | (F.col("a") >= 0.95)})
    return got.select("held", *[F.round(x, 6).alias(x) for x in got.columns if x != "held"])


@query(f"select source_file like 'Friday%' as held_out, is_attack, count(*) as n, count(*) filter (where p >= 0.5) as flagged from {_SCORED} group by 1, 2")
def held_out_day_rows(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    return s.groupBy(F.col("source_file").startswith("Friday").alias("held_out"), "is_attack").agg(F.count("*").alias("n"), F.count_if(F.col("p") >= 0.5).alias("flagged"))


@query("select flow_id, label from flows where split = 'test' and label in (select label from flows where split = 'test' except select label from flows where split = 'train')")
def unseen_label_rows(spark: SparkSession, sf: str) -> DataFrame:
    f = _flows(spark, sf)
    test, train = f.where("split = 'test'"), f.where("split = 'train'")
    return test.join(test.select("label").distinct().join(train.select("label").distinct(), "label", "left_anti"), "label", "left_semi").select("flow_id", "label")


@query(f"""with r as (select split as model, case split when 'train' then 0 when 'val' then 1 else 2 end as pos, round(2 * count(*) filter (where is_attack = 1 and p >= 0.5) / (2 * count(*) filter (where is_attack = 1 and p >= 0.5) + count(*) filter (where is_attack = 0 and p >= 0.5) + count(*) filter (where is_attack = 1 and p < 0.5))::double, 6) as f1 from {_SCORED} group by 1)
select model, f1 from r where model <> 'train' order by f1 desc, pos limit 1""")
def best_model(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.rates(metrics.confusion(_scored(spark, sf), F.col("is_attack"), F.col("p") >= 0.5, ["split"])).select(F.col("split").alias("model"), F.round("f1", 6).alias("f1"), F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2).alias("pos"))
    return metrics.best_model(got, "f1", "pos", F.col("model") == "train").select("model", "f1")


@query("select label, n from (select label, count(*) as n from flows where split = 'train' and label is not null group by 1) order by n desc, label limit 1")
def majority_class(spark: SparkSession, sf: str) -> DataFrame:
    return _flows(spark, sf).where("split = 'train' and label is not null").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1)


# --- serving tables, over batch


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "batch")


@query("""select batch_id, flow_no, source, decision, epoch_us(received_at) as received_us from batch where decision in ('anomaly', 'known_attack')
order by received_at desc, batch_id desc, flow_no desc limit 100""")
def alerts_newest(spark: SparkSession, sf: str) -> DataFrame:
    b = _batch(spark, sf).select("batch_id", "flow_no", "source", "decision", "received_at")
    return serving.newest_alerts(b, F.col("decision"), [F.col("received_at"), F.col("batch_id"), F.col("flow_no")]).select("batch_id", "flow_no", "source", "decision", F.unix_micros("received_at").alias("received_us"))


@query("""select least(count(*), 1000) as held, greatest(count(*) - 1000, 0) as evicted, count(*) filter (where decision = 'benign') as benign, count(*) filter (where decision = 'anomaly') as anomaly, count(*) filter (where decision = 'known_attack') as known_attack from batch""")
def store_state(spark: SparkSession, sf: str) -> DataFrame:
    return serving.store_state(_batch(spark, sf), F.col("decision"), 1000)


_GIVEN = ["Destination Port", "Flow Duration", "Flow Bytes/s", "Flow IAT Mean"]


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of batch as requests: a map of the measures, the source, and who decided on them."""
    values = F.map_from_arrays(F.array(*[F.lit(f" {c} ") for c in _GIVEN], F.lit("Label")), F.array(*[q(c).cast("double") for c in _GIVEN], F.lit(0.0)))
    return _batch(spark, sf).select("batch_id", "flow_no", F.coalesce("source", F.lit("api")).alias("source"), values.alias("features"))


@query(f"""select batch_id, flow_no, missing, count(*) as n from (select batch_id, flow_no, concat_ws(', ', {', '.join(f"case when {_X.format(c)} is null or isinf({_X.format(c)}) then '{c}' end" for c in _GIVEN)}) as missing from batch)
where missing <> '' group by all""")
def request_missing_values(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with features that are null or infinite (NaN is a number that is given)."""
    r = _requests(spark, sf).select("batch_id", "flow_no", F.array_join(requests.missing_values(F.col("features"), _GIVEN), ", ").alias("missing"))
    return r.where("missing <> ''").groupBy("batch_id", "flow_no", "missing").agg(F.count("*").alias("n"))


_ABSENT = ", ".join(f"case when {_X.format(c)} is null then '{c}' end" for c in sorted(_GIVEN))


@query(f"""with p as (select coalesce(source, 'api') as source, concat_ws(', ', {_ABSENT}) as absent, {' and '.join(f'{_X.format(c)} is null' for c in _GIVEN)} as nothing, "Destination Port" > 50000 as odd from batch)
select problems, count(*) as n from (select concat_ws('; ', case when nothing then 'no features' end, case when length(source) > 64 then 'source is longer than 64' end,
  case when odd then 'unknown: High Port' end, case when absent <> '' then 'missing: ' || absent end) as problems from p) group by 1""")
def request_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Why requests would be turned down, if nulls were left out and high ports sent a name of their own."""
    r = _requests(spark, sf)
    given = F.map_filter("features", lambda k, v: v.isNotNull() & (F.trim(k) != "Label"))
    port = F.col("features")[" Destination Port "]
    given = F.when(port > 50000, F.map_concat(given, F.create_map(F.lit("High Port"), port))).otherwise(given)
    return r.select(F.array_join(requests.problems(given, F.col("source"), _GIVEN), "; ").alias("problems")).groupBy("problems").agg(F.count("*").alias("n"))


@query("""with p as (select coalesce(source, 'unknown') as source, count(*) as n, min(received_at) as f, max(received_at) as l, count(*) filter (where decision <> 'benign') as alerts from batch group by 1),
  r as (select *, row_number() over (order by f, source) as rn from p)
select case when rn <= 50 then source else '(other sources)' end as source, sum(n)::bigint as n, epoch_us(max(l)) as last_seen, sum(alerts)::bigint as alerts from r group by 1""")
def source_counters(spark: SparkSession, sf: str) -> DataFrame:
    b = _batch(spark, sf)
    return serving.source_counters(b, F.col("source"), F.col("received_at"), {"alerts": F.coalesce(F.col("decision") != "benign", F.lit(False)).cast("int")}).withColumn("last_seen", F.unix_micros("last_seen"))


@query("""with m as (select max(received_at) as t from batch), p as (select 'replay:' || source as source, max(received_at) as last_seen, count(*) as n from batch where source is not null group by 1)
select source, epoch_us(last_seen) as last_seen, n from p, m where source like 'replay:%' and last_seen > t - interval 6 hours""")
def recent_replays(spark: SparkSession, sf: str) -> DataFrame:
    """The sources as replays, seen within six hours of the newest row (their rows are minutes apart, not seconds)."""
    b = _batch(spark, sf)
    c = b.where("source is not null").groupBy(F.concat(F.lit("replay:"), "source").alias("source")).agg(F.max("received_at").alias("last_seen"), F.count("*").alias("n"))
    now = b.agg(F.max("received_at").alias("t"))
    return serving.recent_sources(c.crossJoin(F.broadcast(now)), F.col("t"), seconds=6 * 3600).drop("t").withColumn("last_seen", F.unix_micros("last_seen"))  # one row


@query("""with b as (select batch_id, count(*) as n from batch group by 1)
select batch_id, n, coalesce(sum(n) over (order by batch_id rows between unbounded preceding and 1 preceding), 0)::double / 200 as due from b""")
def replay_schedule(spark: SparkSession, sf: str) -> DataFrame:
    b = _batch(spark, sf).groupBy("batch_id").agg(F.count("*").alias("n"))
    return serving.schedule(b, "batch_id", "n", 200.0)


@query("""select source_file, flow_id, ((row_number() over (partition by source_file order by flow_id) - 1) // 50)::bigint as batch_no, ((row_number() over (partition by source_file order by flow_id) - 1) % 50)::bigint as row_no
from flows where split = 'test' and source_file like 'Friday%'""")
def frames_from_split(spark: SparkSession, sf: str) -> DataFrame:
    f = _flows(spark, sf).where(F.col("split") == "test").where(F.col("source_file").startswith("Friday")).select("source_file", "flow_id")
    return serving.batches(f, ["source_file"], "flow_id", 50).select("source_file", "flow_id", "batch_no", "row_no")


@query("""select source, decision, count(*) as n, round(avg("Flow Duration") filter (where isfinite("Flow Duration")), 3) as mean_duration from batch group by cube (source, decision)""")
def decisions_cube(spark: SparkSession, sf: str) -> DataFrame:
    from flowquarry.functions.scalars import finite_or_null

    return _batch(spark, sf).cube("source", "decision").agg(F.count("*").alias("n"), F.round(F.avg(finite_or_null(q("Flow Duration"))), 3).alias("mean_duration"))


@query("""select source, quantile_cont("Flow Duration", 0.5) as p50, quantile_cont("Flow Duration", 0.99) as p99 from batch
where isfinite("Flow Duration") group by 1""")
def exact_quantiles_by_source(spark: SparkSession, sf: str) -> DataFrame:
    got = orderstats.exact_quantiles(_batch(spark, sf), ["source"], "Flow Duration", [0.5, 0.99])
    return got.groupBy("source").agg(F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("p50"), F.max(F.when(F.col("prob") == 0.99, F.col("quantile"))).alias("p99"))


# --- further operators of the pipeline

_ALL_NULL = " and ".join(f'"{c}" is null' for c in FEATURES)


@query(f"""select source_file, count(*) as row_count, count(*) filter (where {_ALL_NULL} and label is null) as all_empty, count(*) filter (where {' or '.join(f'("{c}" is null or isnan("{c}") or isinf("{c}"))' for c in FEATURES)}) as with_gaps from flows group by 1""")
def empty_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without any cell, and rows with at least one missing or infinite cell, per file."""
    from functools import reduce

    from flowquarry.functions.scalars import is_finite

    empty = reduce(lambda a, b: a & b, [q(c).isNull() for c in FEATURES]) & F.col("label").isNull()
    gaps = reduce(lambda a, b: a | b, [~is_finite(q(c)) for c in FEATURES])
    return _flows(spark, sf).groupBy("source_file").agg(F.count("*").alias("row_count"), F.count_if(empty).alias("all_empty"), F.count_if(gaps).alias("with_gaps"))


@query(f"""select flow_id, label from (select flow_id, label, row_number() over (partition by label order by {_MD5}) as rn from flows where split = 'test') where rn <= case when upper(trim(label)) = 'BENIGN' then 50 else 10 end""")
def capped_sample(spark: SparkSession, sf: str) -> DataFrame:
    """At most 50 benign rows and 10 of every other label, for explanations."""
    f = _flows(spark, sf).where("split = 'test'").select("flow_id", "label")
    got = sampling.stratified_sample(f, F.col("label"), 50, sampling.order_key("42", F.col("flow_id")))
    other = sampling.stratified_sample(got.where(~F.coalesce(F.upper(F.trim("label")) == "BENIGN", F.lit(False))), F.col("label"), 10, sampling.order_key("42", F.col("flow_id")))
    return got.where(F.upper(F.trim("label")) == "BENIGN").unionByName(other)


@query(f"select label, round(avg((p >= 0.5)::int), 4) as recall from {_SCORED} where is_attack = 1 group by 1")
def recall_by_label(spark: SparkSession, sf: str) -> DataFrame:
    got = metrics.per_label_rates(_scored(spark, sf).where("is_attack = 1"), F.col("label"), F.col("p") >= 0.5)
    return got.select("label", F.round("rate", 4).alias("recall"))


@query("select label, min(flow_id) as flow_id from flows where label is not null group by 1")
def example_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The row of each label that becomes its example request."""
    return _flows(spark, sf).where("label is not null").groupBy("label").agg(F.min("flow_id").alias("flow_id"))


@query(f"""select flow_id, case when isfinite(x) then round(sign(x) * log10(1 + abs(x)), 6) else -1 end as slog10 from (select flow_id, {_X.format('Flow IAT Mean')} as x from flows)""")
def signed_log(spark: SparkSession, sf: str) -> DataFrame:
    from flowquarry.functions.scalars import finite_or_null, signed_log10

    x = finite_or_null(q("Flow IAT Mean").cast("double"))
    return _flows(spark, sf).select("flow_id", F.coalesce(F.round(signed_log10(x), 6), F.lit(-1.0)).alias("slog10"))


@query("""select source, sum((decision = 'known_attack')::int)::bigint as known_attack, sum((decision = 'anomaly')::int)::bigint as anomaly, sum((decision = 'benign')::int)::bigint as benign, count(*) as n, count(distinct (batch_id, flow_no)) as distinct_flows
from batch where source is not null group by 1""")
def decisions_by_source(spark: SparkSession, sf: str) -> DataFrame:
    b = _batch(spark, sf).where("source is not null")
    return b.groupBy("source").agg(*[F.coalesce(F.sum((F.col("decision") == d).cast("int")), F.lit(0)).alias(d) for d in ("known_attack", "anomaly", "benign")], F.count("*").alias("n"), F.count_distinct("batch_id", "flow_no").alias("distinct_flows"))


@query("""select batch_id, flow_no, source, epoch_us(received_at) as received_us from (select *, row_number() over (partition by batch_id, flow_no order by received_at, source nulls first, decision nulls first, "Flow Duration" nulls first) as rn from batch) where rn = 1""")
def first_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Each flow's first delivery: later ones with its (batch_id, flow_no) are copies."""
    from pyspark.sql import Window

    w = Window.partitionBy("batch_id", "flow_no").orderBy("received_at", F.asc_nulls_first("source"), F.asc_nulls_first("decision"), F.asc_nulls_first("Flow Duration"))
    return _batch(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("batch_id", "flow_no", "source", F.unix_micros("received_at").alias("received_us"))
