"""Profiles of every column of every file, and what has gone wrong since the sensor's previous file."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.operators.linetable import KMV, parse_lines
from flowquarry.operators.schemadrift import Files


def column_profiles(files: Files) -> DataFrame:
    """One row per file and column, from counts that add up over chunks, files and loads.

    distinct counts the different non-missing cells. States hold the KMV smallest hashes: with fewer the count is exact;
    where they are full and the files' lines are at hand, the column is counted exactly in a second pass over these files'
    lines only; else it is estimated, distinct_exact is false and distinct_error is three standard errors.
    """
    c = files.columns
    n = F.col("finite")
    out = c.select(
        "file_no", F.col("name").alias("column_name"), "kind", "lines", "missing", "infinite", "pos_inf", (F.col("texts") + F.col("timestamps")).alias("other_cells"),
        n.alias("finite_count"), F.try_divide(F.col("total"), n).alias("mean"), F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("std"), "least", "most", "median", "zeros", "negatives", "position",
        F.coalesce((n > 0) & (F.col("least") == F.col("most")), F.lit(False)).alias("constant"),
    )
    hashes = files.stats.where("distinct_hashes is not null").select("file_no", "position", F.explode("distinct_hashes").alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy("file_no", "position").orderBy("h"))
    kept = hashes.withColumn("r", rank).where(F.col("r") <= KMV).groupBy("file_no", "position").agg(F.count("*").alias("k"), F.max("h").alias("top"))
    share = (F.col("top").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    full = F.col("k") >= KMV
    est = kept.select("file_no", "position", F.when(full, F.round((KMV - 1) / share)).otherwise(F.col("k")).cast("long").alias("distinct"), (~full).alias("distinct_exact"))
    again = est.where("not distinct_exact").select("file_no", "position")
    if files.raw is not None and not again.isEmpty():
        lines = files.raw.join(again.select("file_no").distinct().hint("merge"), "file_no", "left_semi")
        cells = parse_lines(lines, stats=False, cells=True).where("line is not null").select("line.file_no", F.posexplode("line.cells").alias("position", "cell"))
        cells = cells.where(~F.col("cell").rlike(r"(?i)^(nan|na|null)?$")).join(again.hint("merge"), ["file_no", "position"], "left_semi")
        exact = cells.distinct().groupBy("file_no", "position").agg(F.count("*").alias("counted"))
        est = est.join(exact.hint("merge"), ["file_no", "position"], "left").select("file_no", "position", F.coalesce("counted", "distinct").alias("distinct"), (F.col("distinct_exact") | F.col("counted").isNotNull()).alias("distinct_exact"))
    est = est.withColumn("distinct_error", F.when(F.col("distinct_exact"), 0.0).otherwise(F.col("distinct") * 3 / F.sqrt(F.lit(KMV - 2.0))))
    out = out.join(est.hint("merge"), ["file_no", "position"], "left").drop("position")
    return out.withColumn("distinct", F.coalesce("distinct", F.lit(0))).withColumn("distinct_exact", F.coalesce("distinct_exact", F.lit(True))).withColumn("distinct_error", F.coalesce("distinct_error", F.lit(0.0)))


@dataclass(frozen=True)
class Check:
    """A constraint on the columns of a file, by its test.

    share: more than ``limit`` of the lines have a cell of ``of`` (bad or infinite); range: a value beyond the dictionary's
    least or most; pattern: a cell that doesn't fit its field's pattern; rise: the share of ``of`` is more than ``limit``
    higher than in the file before; constant: all values equal now, but not before; ratio: the median is ``limit`` times
    the one before or more, or as small a part of it. rise, constant and ratio compare number columns of the same field.
    """

    issue: str
    test: str
    of: str = ""
    limit: float = 0.0


CHECKS = (
    Check("unparseable", "share", "bad", 0.05), Check("infinite", "share", "infinite", 0.05), Check("range", "range"), Check("pattern", "pattern"),
    Check("missing", "rise", "lost", 0.2), Check("constant", "constant"), Check("shift", "ratio", "median", 4),
)


def _compiled(check: Check, patterned: Sequence[str]) -> Column:
    now, old = F.col(check.of) if check.of else None, F.col(f"o_{check.of}") if check.of else None
    number = F.col("number")
    pair = number & F.coalesce("o_number", F.lit(False))
    # decimal fractions as exact ratios of whole numbers
    part, whole = (round(check.limit * 1000), 1000)
    if check.test == "share":
        return number & (now * whole > F.col("lines") * part)
    if check.test == "range":
        return number & ((F.col("least") < F.col("lo")) | (F.col("most") > F.col("hi")))
    if check.test == "pattern":
        fits = [(F.col("field") == f) & (F.col("lines") - F.col("missing") > F.col("fitted")[i]) for i, f in enumerate(patterned)]
        return F.coalesce(*[F.when(x, True) for x in fits], F.lit(False)) if fits else F.lit(False)
    if check.test == "rise":
        return pair & ((now * F.col("o_lines") - old * F.col("lines")) * whole > F.col("lines") * F.col("o_lines") * part)
    if check.test == "constant":
        return pair & (F.col("finite") >= 2) & (F.col("least") == F.col("most")) & (F.col("o_finite") >= 2) & (F.col("o_least") < F.col("o_most"))
    if check.test == "ratio":
        return pair & (now > 0) & (old > 0) & ((now >= check.limit * old) | (now * check.limit <= old))
    raise ValueError(f"no such test: {check.test}")


def quality_issues(files: Files, checks: Sequence[Check] = CHECKS) -> DataFrame:
    """(file_no, column_name, issue): the columns that break a constraint; all constraints are one projection over the shared scan's states."""
    ranges = files.columns.sparkSession.createDataFrame([(f, d.get("least"), d.get("most"), d.get("kind") == "timestamp") for f, d in files.known.items()], "field string, lo double, hi double, is_time boolean")
    fields = files.links.where("name is not null").select("file_no", "prev_file_no", "name", "prev_name", "field", "listed")
    cols = files.columns.join(fields.hint("merge"), ["file_no", "name"]).join(F.broadcast(ranges), "field", "left")  # the dictionary is of fixed size
    number = F.col("kind").isin("whole", "decimal") & ~F.coalesce("is_time", F.lit(False))
    bad = F.col("texts") + F.col("timestamps")
    now = cols.select(
        "file_no", "name", "prev_file_no", "prev_name", "field", "lines", "infinite", "least", "most", "median", "finite", "missing", "fitted", "lo", "hi",
        F.coalesce(number, F.lit(False)).alias("number"), bad.alias("bad"), (F.col("missing") + bad).alias("lost"),
    )
    old = now.select(*[F.col(c).alias(f"o_{c}") for c in ("number", "lost", "bad", "infinite", "lines", "finite", "least", "most", "median")], F.col("file_no").alias("prev_file_no"), F.col("name").alias("prev_name"))
    both = now.join(old.hint("merge"), ["prev_file_no", "prev_name"], "left")
    issues = F.array_compact(F.array(*[F.when(_compiled(c, files.patterned), c.issue) for c in checks]))
    return both.select("file_no", F.col("name").alias("column_name"), F.explode(issues).alias("issue"))


def recorded_comparison(profiles: DataFrame, recorded: DataFrame) -> DataFrame:
    """(file_no, column_name, measure, recorded, found, agrees): recorded profiles beside those of the lines.

    recorded.nan counts missing and unparseable cells. Recorded rows that came twice count once; columns without a
    recorded row are not compared, recorded columns that a file doesn't have are given with found null and don't agree.
    Numbers agree within 1e-9 of their size, deviations within 1e-9 of the mean's or the deviation's.
    """
    r = recorded.dropDuplicates(["file_no", "column_name"])
    f = profiles.withColumn("nan", F.col("missing") + F.col("other_cells")).withColumn("neg_inf", F.col("infinite") - F.col("pos_inf")).withColumn("min", F.col("least")).withColumn("max", F.col("most")).withColumn("unparseable", F.col("other_cells"))
    names = ["finite_count", "nan", "pos_inf", "neg_inf", "zeros", "negatives", "unparseable", "min", "max", "mean", "std", "constant"]
    have = [n for n in names if n in recorded.columns]
    pick = lambda d, new: d.select("file_no", "column_name", *[F.col(n).cast("double").alias(f"{new}{i}") for i, n in enumerate(have)])
    both = pick(r, "r").join(pick(f, "f").withColumn("here", F.lit(True)).hint("merge"), ["file_no", "column_name"], "left")
    mean = F.abs(F.col(f"f{have.index('mean')}")) if "mean" in have else F.lit(0.0)
    # a deviation of equal values is rounding in the mean's size; that of one value is recorded as 0 or not at all
    slack = lambda n: F.coalesce(mean, F.lit(0.0)) if n == "std" else F.lit(0.0)
    each = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"r{i}").alias("recorded"), F.col(f"f{i}").alias("found"), slack(n).alias("slack"), F.col("here").alias("here")) for i, n in enumerate(have)])
    long = both.select("file_no", "column_name", F.explode(each).alias("x")).select("file_no", "column_name", "x.*")
    near = F.abs(F.col("recorded") - F.col("found")) <= 1e-9 * F.greatest(F.abs("recorded"), F.abs("found"), "slack")
    same = F.col("recorded").eqNullSafe(F.col("found")) | F.coalesce(near, F.lit(False)) | ((F.col("measure") == "std") & F.coalesce(F.col("recorded") == 0, F.lit(False)) & F.col("found").isNull())
    return long.select("file_no", "column_name", "measure", "recorded", "found", (same & F.col("here").isNotNull()).alias("agrees"))


def recorded_differences(profiles: DataFrame, recorded: DataFrame) -> DataFrame:
    """(file_no, column_name, measure, recorded, found): where recorded profiles disagree with those of the lines."""
    return recorded_comparison(profiles, recorded).where("not agrees").drop("agrees")


#: Files of one sensor and field that one task goes through, and earlier files that limits are drawn from.
SPAN, HISTORY = 1000, 30


def control_limits(files: Files, reports: DataFrame, *, history: int = HISTORY, least: int = 4, width: float = 3.0, span: int = SPAN) -> DataFrame:
    """(file_no, column_name, field, metric, value, files, low, high, outside): each metric against the sensor's earlier files.

    Metrics of number columns: share of missing or unparseable cells, share of infinite cells, logarithm of the median's
    size. Limits are the mean of at most ``history`` files before (by seq) plus and minus ``width`` deviations, with at
    least a hundredth to each side; fewer than ``least`` files give no limits and outside is null. The files in which a
    sensor has the field as a number column are ranked (by counts per block of seq and ranks within a block) and gone
    through in spans of ranks that overlap by the history, so that a sensor with very many files is no single group.
    """
    place = reports.where("file_no is not null").groupBy("file_no").agg(F.max("sensor").alias("sensor"), F.max("seq").alias("seq"))
    fields = files.links.where("name is not null").select("file_no", "name", "field")
    cols = files.columns.where("kind in ('whole', 'decimal')").join(fields.hint("merge"), ["file_no", "name"]).join(place.hint("merge"), "file_no").where("sensor is not null and seq is not null")
    share = lambda c: F.try_divide(c, F.col("lines"))
    values = {"lost": share(F.col("missing") + F.col("texts") + F.col("timestamps")), "infinite": share(F.col("infinite")), "median": F.signum("median") * F.log1p(F.abs("median"))}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in values.items()])).alias("m")
    long = cols.select("sensor", "seq", "file_no", F.col("name").alias("column_name"), "field", each).select("sensor", "seq", "file_no", "column_name", "field", "m.metric", "m.value")
    key = ["sensor", "field", "metric"]
    long = long.withColumn("block", F.floor(F.col("seq") / span))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = long.groupBy(*key, "block").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = long.withColumn("r", F.row_number().over(Window.partitionBy(*key, "block").orderBy("seq", "file_no"))).join(starts.hint("merge"), [*key, "block"])
    long = ranked.withColumn("place", F.col("start") + F.col("r") - 1).drop("start", "r", "block")
    own = F.floor(F.col("place") / span)
    spans = F.explode(F.when(F.col("place") % span >= span - history, F.array(own, own + 1)).otherwise(F.array(own))).alias("part")
    w = Window.partitionBy(*key, "part").orderBy("place").rowsBetween(-history, -1)
    n, mean, dev = F.count("value").over(w), F.avg("value").over(w), F.coalesce(F.stddev_samp("value").over(w), F.lit(0.0))
    out = long.select("*", spans).withColumn("files", n).withColumn("mean", mean).withColumn("dev", F.greatest(F.lit(width) * dev, F.lit(0.01)))
    out = out.where(F.col("part") == own)
    limit = lambda s: F.when(F.col("files") >= least, F.col("mean") + s * F.col("dev"))
    out = out.withColumn("low", limit(-1)).withColumn("high", limit(1))
    return out.select("file_no", "column_name", "field", "metric", "value", "files", "low", "high", ((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("outside"))
