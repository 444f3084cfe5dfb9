"""Queries on the star schema, events, documents and embeddings: joins, sets, windows, event time, request checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowquarry.functions.scalars import signed_log1p, signed_log10
from flowquarry.operators import metrics, serving
from flowquarry.plans.registry import Query, collector, table
from flowquarry.session import shared_dir
from flowquarry.streaming import replay

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
query = collector(QUERIES, SQL)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


# --- joins, sets, grouping sets, windows


@query("""select n_name, r_name, o_orderpriority, count(*) as orders, round(sum(o_totalprice), 2) as total
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2, 3""")
def join_star(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    # nation and region are of fixed size; the sides' sizes decide on the other joins
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("n_name", "r_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
def join_semi(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 350000)")
def join_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without a large order."""
    o = table(spark, sf, "orders").where("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""with a as (select p_partkey as k, count(*) as parts from part where p_size > 25 group by 1), b as (select l_partkey as k, count(*) as lines from lineitem where l_quantity > 45 group by 1)
select coalesce(a.k, b.k) as k, coalesce(parts, 0) as parts, coalesce(lines, 0) as lines from a full join b on a.k = b.k""")
def join_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "part").where("p_size > 25").groupBy(F.col("p_partkey").alias("k")).agg(F.count("*").alias("parts"))
    b = table(spark, sf, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("lines"))
    return a.join(b, "k", "full").select("k", F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("lines", F.lit(0)).alias("lines"))


@query("""select a.column_name as column_a, b.column_name as column_b from column_dict a join column_dict b on a.column_name < b.column_name and a.kind = b.kind""")
def join_triangular(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "column_dict").select("column_name", "kind")
    a, b = d.alias("a"), d.alias("b")
    return a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.column_name") < F.col("b.column_name"))).select(F.col("a.column_name").alias("column_a"), F.col("b.column_name").alias("column_b"))


@query("""select coalesce(l_returnflag, '*') as l_returnflag, coalesce(l_linestatus, '*') as l_linestatus, coalesce(extract(year from l_shipdate)::integer, 0) as year, count(*) as n, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, grouping(l_returnflag)::integer + grouping(l_linestatus)::integer + grouping(extract(year from l_shipdate)::integer)::integer as level
from lineitem group by rollup (l_returnflag, l_linestatus, extract(year from l_shipdate)::integer)""")
def rollup_revenue(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    g = F.grouping("l_returnflag").cast("int") + F.grouping("l_linestatus").cast("int") + F.grouping("year").cast("int")
    return d.rollup("l_returnflag", "l_linestatus", "year").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), g.alias("level")).na.fill("*", ["l_returnflag", "l_linestatus"]).na.fill(0, ["year"])


@query("""select c_custkey, c_name, round(sum(o_totalprice), 2) as spent from customer join orders on c_custkey = o_custkey group by 1, 2 order by sum(o_totalprice) desc, c_custkey limit 25""")
def top_customers(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("s"))
    return table(spark, sf, "customer").join(j, "c_custkey").orderBy(F.desc("s"), "c_custkey").limit(25).select("c_custkey", "c_name", F.round("s", 2).alias("spent"))


@query("""(select l_partkey as k from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A')
except select p_partkey from part where p_size < 10""")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    pick = lambda f: line.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    return pick("R").intersect(pick("A")).subtract(table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("k")))


@query("""select 'orders' as part, o_custkey as k, count(*) as n from orders group by 2 union all select 'customers', c_nationkey::bigint, count(*) from customer group by 2""")
def union_tagged(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).withColumn("part", F.lit("orders"))
    b = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.count("*").alias("n")).withColumn("part", F.lit("customers"))
    return a.unionByName(b)


@query("""select event_type, user_id, n, rank from (select event_type, user_id, count(*) as n, row_number() over (partition by event_type order by count(*) desc, user_id) as rank from events group by 1, 2) where rank <= 5""")
def top_users_by_type(spark: SparkSession, sf: str) -> DataFrame:
    n = _events(spark, sf).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id")).cast("long")).where("rank <= 5")


@query("""select p.event_id as purchase_id, coalesce(max_by(v.event_id, (v.ts, v.event_id)), -1) as view_id from events p left join events v on v.user_id = p.user_id and v.event_type = 'view' and v.ts <= p.ts
where p.event_type = 'purchase' group by 1""")
def asof_join(spark: SparkSession, sf: str) -> DataFrame:
    """The last view before each purchase, by one sort over both kinds of events instead of a range join."""
    e = _events(spark, sf).where("event_type in ('view', 'purchase')")
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    kind = F.when(F.col("event_type") == "view", 0).otherwise(1)
    w = Window.partitionBy("user_id").orderBy("ts", kind, "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("view_id", F.last(view, ignorenulls=True).over(w)).where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.coalesce("view_id", F.lit(-1).cast("long")).alias("view_id"))


# --- scalar functions


@query("""select n_nationkey, trim(n_name) as name, upper(n_name) as up, left(n_name, 4) as start, replace(lower(n_name), ' ', '_') as slug, not regexp_matches(n_name, '[^\\x00-\\x7F]') as ascii,
  n_name ilike 'uni%' as united, split_part(n_name, ' ', 1) as first, round(sign(n_nationkey - 12) * log10(1 + abs(n_nationkey - 12)), 8) as slog10, round(sign(n_nationkey - 12) * ln(1 + abs(n_nationkey - 12)), 8) as slog1p,
  case when n_nationkey = 0 then null else round(100.0::double / n_nationkey, 6) end as ratio, try_cast(n_name as double) as number from nation""")
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    x = (F.col("n_nationkey") - 12).cast("double")
    return n.select(
        "n_nationkey", F.trim("n_name").alias("name"), F.upper("n_name").alias("up"), F.left("n_name", F.lit(4)).alias("start"), F.replace(F.lower("n_name"), F.lit(" "), F.lit("_")).alias("slug"), (~F.col("n_name").rlike(r"[^\x00-\x7F]")).alias("ascii"),
        F.col("n_name").rlike("(?i)^uni").alias("united"), F.split_part("n_name", F.lit(" "), F.lit(1)).alias("first"), F.round(signed_log10(x), 8).alias("slog10"), F.round(signed_log1p(x), 8).alias("slog1p"),
        F.round(F.try_divide(F.lit(100.0), F.col("n_nationkey")), 6).alias("ratio"), F.col("n_name").try_cast("double").alias("number"),
    )


@query("""select column_name, case when least is null then 'text' when least = floor(least) and column_name not like '%/s' then 'int' else 'float' end as sniffed, least as number from column_dict""")
def sniffed_cells(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "column_dict")
    cell = F.when(F.col("least").isNull(), "none").when((F.col("least") == F.floor("least")) & ~F.col("column_name").endswith("/s"), F.col("least").cast("long").cast("string")).otherwise(F.concat(F.col("least").cast("string"), F.lit("")))
    s = serving.sniffed(cell)
    return d.select("column_name", s["kind"].alias("sniffed"), s["number"].alias("number"))


# --- request checks


_KEYS = "(json_exists(props, '$.k')::int + json_exists(props, '$.n')::int)"


@query(f"""select event_id, json_extract_string(props, '$.k')::double as k, (len(json_keys(props)) - {_KEYS})::integer as unknown, 2 - {_KEYS} as absent,
  case when json_type(props, '$.k') in ('UBIGINT', 'BIGINT', 'DOUBLE') then 0 else 1 end as not_numeric from events""")
def props_validation(spark: SparkSession, sf: str) -> DataFrame:
    c = serving.checked_features(F.col("props"), ["k", "n"])
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "double")
    return _events(spark, sf).select("event_id", k.alias("k"), *[F.size(c[x]).alias(x) for x in ("unknown", "absent", "not_numeric")])


@query("""select file_no, count(*) filter (where contains(line_text, '"')) as quoted, count(*) filter (where not contains(line_text, '"') and width <> head) as ragged, count(*) filter (where not contains(line_text, '"') and width = head) as good from
  (select file_no, line_text, len(string_split(line_text, ',')) as width, head from (select distinct file_no, line_no, line_text from raw_lines) l join (select distinct file_no, len(string_split(line_text, ',')) as head from raw_lines where line_no = 1) using (file_no) where line_no > 1 and trim(line_text, e' \\t\\r\\n') <> '') group by 1""")
def client_csv_errors(spark: SparkSession, sf: str) -> DataFrame:
    """What a strict reader of plain CSV refuses: quoted fields, and rows that are longer or shorter than the header."""
    raw = table(spark, sf, "raw_lines").dropDuplicates(["file_no", "line_no"])
    width = F.size(F.split("line_text", ",", -1))
    head = raw.where("line_no = 1").select("file_no", width.alias("head"))
    d = raw.where("line_no > 1").where(F.trim("line_text", F.lit(" \t\r\n")) != "").select("file_no", F.contains("line_text", F.lit('"')).alias("quote"), width.alias("width")).join(head, "file_no")
    return d.groupBy("file_no").agg(F.count_if("quote").alias("quoted"), F.count_if(~F.col("quote") & (F.col("width") != F.col("head"))).alias("ragged"), F.count_if(~F.col("quote") & (F.col("width") == F.col("head"))).alias("good"))


@query("""with c as (select event_id, unnest(['clicks', 'errors', 'value']) as feature, unnest([event_id % 7 - 3, event_id % 5 - 2, event_id % 11 - 5])::double as shap from events)
select event_id, feature, shap from (select *, row_number() over (partition by event_id order by abs(shap) desc, feature) as rn from c) where rn <= 2""")
def contributions_topk(spark: SparkSession, sf: str) -> DataFrame:
    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(0.0).alias("value"), (F.col("event_id") % m - k).cast("double").alias("shap")) for n, m, k in (("clicks", 7, 3), ("errors", 5, 2), ("value", 11, 5))])
    e = _events(spark, sf).select("event_id", F.explode(serving.top_contributions(items, 2)["top"]).alias("c"))
    return e.select("event_id", "c.feature", "c.shap")


@query("""select feature, round(avg(abs(shap)), 8) as mean_abs_shap from (select unnest(['clicks', 'errors', 'value']) as feature, unnest([event_id % 7 - 3, event_id % 5 - 2, event_id % 11 - 5])::double as shap from events) group by 1""")
def mean_abs_contribution(spark: SparkSession, sf: str) -> DataFrame:
    from flowquarry.operators.explain import importance

    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(0.0).alias("value"), (F.col("event_id") % m - k).cast("double").alias("shap")) for n, m, k in (("clicks", 7, 3), ("errors", 5, 2), ("value", 11, 5))])
    return importance(_events(spark, sf).select(items.alias("contributions"))).withColumn("mean_abs_shap", F.round("mean_abs_shap", 8))


# --- event time, in batch and as streams

_HOUR = "select epoch_us(date_trunc('hour', ts)) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"


@query(_HOUR)
def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    got = replay.tumbling(e, "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return got.withColumn("window_start", F.unix_micros("window_start"))


@query("""with s as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minutes or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
  n as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as no from s)
select user_id, epoch_us(min(ts)) as session_start, epoch_us(max(ts) + interval 30 minutes) as session_end, count(*) as n from n group by user_id, no""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    got = replay.sessions(e, "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")])
    return got.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """events as a stream of one file."""
    import os

    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    if os.path.isdir(path):
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _run(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    return replay.run_available(df, mode, f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}")


@query("select event_type, case when value >= 50 then 'known_attack' when value >= 20 then 'anomaly' else 'benign' end as decision, count(*) as n from events group by 1, 2")
def stream_tally(spark: SparkSession, sf: str) -> DataFrame:
    """A running contingency table of a scored stream."""
    e = _stream(spark, sf).withColumn("decision", metrics.hybrid_decision(F.col("value"), F.col("value"), 20.0, 50.0))
    return _run(spark, e.groupBy("event_type", "decision").agg(F.count("*").alias("n")), "complete")


@query(_HOUR.replace(", round(sum(value), 4) as total", ""))
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    e = replay.event_time(_stream(spark, sf), "ts", "1 day")
    got = replay.tumbling(e, "ts", "1 hour", ["event_type"], [F.count("*").alias("n")])
    return _run(spark, got, "complete").withColumn("window_start", F.unix_micros("window_start"))


@query("select distinct user_id, event_type from events")
def stream_first_copies(spark: SparkSession, sf: str) -> DataFrame:
    e = replay.event_time(_stream(spark, sf).select("user_id", "event_type", "ts"), "ts", "3650 days")
    return _run(spark, replay.first_copies(e, ["user_id", "event_type"]), "append").select("user_id", "event_type")


@query("select event_type, unnest(keys) as event_id from (select event_type, min(event_id, 5) as keys from events group by 1)")
def stream_bottom_k(spark: SparkSession, sf: str) -> DataFrame:
    got = _run(spark, replay.bottom_k_stream(_stream(spark, sf).select("event_type", "event_id"), "event_type", "event_id", 5), "update")
    w = Window.partitionBy("event_type").orderBy(F.desc("n"), "m")
    last = got.withColumn("n", F.size("keys")).withColumn("m", F.array_max("keys")).withColumn("r", F.row_number().over(w)).where("r = 1")
    return last.select("event_type", F.explode("keys").alias("event_id"))


# --- documents and embeddings: exact copies and array functions


@query("select min(doc_id) as doc_id, count(*) as copies from documents where text is not null group by text having count(*) > 1")
def document_copies(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").select("doc_id", "copies")


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm, len(embedding)::integer as dim from embeddings")
def embedding_norms(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return e.select("vec_id", F.round(norm, 5).alias("norm"), F.size("embedding").alias("dim"))
