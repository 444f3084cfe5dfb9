"""Lines that cannot be loaded, with the reason, and the counts that loaders report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.operators.schemadrift import _MISSING, Files, converted


def judged_lines(files: Files) -> DataFrame:
    """(file_no, line_no, reason, failing, cells): every data line; reason is null for a line that loads.

    The first reason that applies: header, quoting, columns, value; blank lines have the reason blank. A line has the
    reason value if a cell does not fit its column's kind in that file or if its label is unknown; failing names the
    columns of these cells (the label column if the label is unknown).
    """
    marks = files.columns.groupBy("file_no").agg(F.array_sort(F.collect_list(F.struct("position", "name", "kind"))).alias("c"))  # the columns of a file
    bits = lambda *kinds: F.expr(
        f"transform(sequence(0, int((size(c) - 1) / 62)), w -> aggregate(slice(c, 62 * w + 1, 62), 0L, (a, x) -> a | if(x.kind in ({', '.join(map(repr, kinds))}), shiftleft(1L, x.position % 62), 0L)))"
    )
    label = F.expr("filter(c, x -> lower(x.name) = 'label')[0].name")
    masks = marks.select("file_no", "c", bits("whole", "decimal").alias("number_words"), bits("timestamp").alias("time_words"), label.alias("label"))
    both = files.lines.join(masks.hint("merge"), "file_no", "left")
    hit = lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))
    wrong = F.zip_with(hit("no_number", "number_words"), hit("no_time", "time_words"), lambda x, y: F.coalesce(x, F.lit(0)).bitwiseOR(F.coalesce(y, F.lit(0))))
    both = both.withColumn("wrong", wrong)
    value = F.coalesce(~F.col("label_ok") | F.exists("wrong", lambda x: x != 0), F.lit(False))
    cells = F.expr("transform(filter(c, x -> (shiftright(wrong[int(x.position / 62)], x.position % 62) & 1L) = 1L), x -> x.name)")
    failing = F.when(F.col("reason").isNull() & value, F.array_distinct(F.concat(F.coalesce(cells, F.array().cast("array<string>")), F.when(~F.col("label_ok"), F.array("label")).otherwise(F.array().cast("array<string>")))))
    return both.select("file_no", "line_no", F.coalesce("reason", F.when(value, "value")).alias("reason"), failing.alias("failing"), "cells")


def loaded_rows(files: Files) -> DataFrame:
    """(file_no, line_no, numbers, timestamps, texts): the lines that load, their cells cast to their column's kind, by column name.

    Whole and decimal columns are in numbers (infinite cells as infinities); missing cells are left out.
    """
    heads = files.columns.groupBy("file_no").agg(F.array_sort(F.collect_list(F.struct("position", "name", F.coalesce("kind", F.lit("text")).alias("kind")))).alias("c"))
    rows = judged_lines(files).where("reason is null").join(heads.hint("merge"), "file_no")
    cells = F.filter(F.zip_with("c", "cells", lambda c, x: F.struct(c["name"].alias("name"), c["kind"].alias("kind"), x.alias("cell"))), lambda x: ~x["cell"].rlike(_MISSING))
    rows = rows.select("file_no", "line_no", cells.alias("x"))

    def of(kinds: list[str], kind: str) -> Column:
        return F.map_from_entries(F.transform(F.filter("x", lambda x: x["kind"].isin(kinds)), lambda x: F.struct(x["name"], converted(x["cell"], kind))))

    return rows.select("file_no", "line_no", of(["whole", "decimal"], "decimal").alias("numbers"), of(["timestamp"], "timestamp").alias("timestamps"), of(["text"], "text").alias("texts"))


def load_balance(files: Files, reports: DataFrame) -> DataFrame:
    """Per file: counted lines by outcome beside the reported data_lines and rows.

    expected_rows follows the earlier loader: it dropped blank lines, lines with too many cells and bad quotes, and
    kept the rest; only its total can be held against the report, as columns counts both too few and too many.
    """
    j = judged_lines(files)
    count = lambda r: F.count_if(F.coalesce("reason", F.lit("loaded")) == r)
    per = j.groupBy("file_no").agg(F.count("*").alias("lines"), count("loaded").alias("loaded"), count("blank").alias("blank"), count("header").alias("header"), count("quoting").alias("quoting"), count("columns").alias("columns"), count("value").alias("value"))
    rep = reports.where("file_no is not null").groupBy("file_no").agg(F.max("data_lines").alias("data_lines"), F.max("rows").alias("reported_rows"))
    return per.join(rep.hint("merge"), "file_no", "left")
